"""Dimension data: roles, keywords, scopes, appendix headings and the methodology glossary, as plain values."""

from __future__ import annotations

# The roles of sections, with content class and study scope.
ROLES = (
    ("abstract", "analytical", "manuscript"),
    ("introduction", "analytical", "both"),
    ("literature_review", "analytical", "manuscript"),
    ("theory", "analytical", "study"),
    ("methodology", "analytical", "study"),
    ("results", "analytical", "study"),
    ("discussion", "analytical", "both"),
    ("limitations", "analytical", "study"),
    ("conclusion", "analytical", "both"),
    ("acknowledgments", "administrative", "manuscript"),
    ("funding", "administrative", "manuscript"),
    ("author_contributions", "administrative", "manuscript"),
    ("data_availability", "compliance_disclosure", "manuscript"),
    ("ethics_statement", "compliance_disclosure", "manuscript"),
    ("conflict_of_interest", "administrative", "manuscript"),
    ("references", "citation_source", "manuscript"),
    ("Unknown", "analytical", "undetermined"),
)

# The headings that name a role.
KEYWORDS = {
    "abstract": (
        "abstract", "summary",
    ),
    "introduction": (
        "introduction", "background", "overview",
    ),
    "literature_review": (
        "literature review", "related work", "related literature", "prior research", "prior literature",
        "review of literature", "background literature", "state of the art", "extant literature",
    ),
    "theory": (
        "theoretical framework", "theoretical background", "conceptual framework", "theory development",
        "theory and hypotheses", "hypothesis development", "hypotheses development", "conceptual model",
        "research model", "theoretical foundations",
    ),
    "methodology": (
        "method", "methods", "methodology", "research design", "research methodology", "empirical strategy",
        "empirical approach", "analytic approach", "estimation strategy", "materials and methods", "study design",
        "data and methods", "data and method", "sample", "sampling", "participants", "respondents",
        "data collection", "data source", "data sources", "study sample", "sample and data",
        "sample characteristics", "population and sample", "measures", "measurement", "measurement model",
        "operationalization", "operationalisation", "variables", "variable", "instrument", "instruments",
        "survey instrument", "construct measurement", "procedure", "procedures", "data collection procedure",
        "case description", "research setting", "empirical setting", "study context", "case study context",
        "site description", "field setting", "manipulation check", "manipulation checks", "construct validity",
        "discriminant validity", "convergent validity", "reliability analysis", "model specification",
        "hypothesis testing",
    ),
    "results": (
        "results", "empirical results", "findings", "analysis and results", "descriptive statistics",
        "results and analysis", "empirical findings", "quantitative results", "additional analyses",
        "supplementary analyses", "post hoc analysis", "post hoc analyses", "robustness checks", "robustness check",
        "robustness tests", "sensitivity analysis", "sensitivity analyses", "replication study",
        "replication analysis", "thematic findings", "case findings", "qualitative results",
    ),
    "discussion": (
        "discussion", "general discussion", "discussion of results", "discussion and implications",
        "theoretical implications", "implications for theory", "contribution to theory", "practical implications",
        "implications for practice", "managerial implications", "implications for managers", "policy implications",
        "implications for policy",
    ),
    "limitations": (
        "limitations", "study limitations", "limitations of the study", "future research",
        "future research directions", "directions for future research", "avenues for future research",
    ),
    "conclusion": (
        "conclusion", "conclusions", "concluding remarks", "summary and conclusion", "summary and conclusions",
        "final remarks",
    ),
    "acknowledgments": (
        "acknowledgments", "acknowledgements",
    ),
    "funding": (
        "funding", "funding statement", "financial support", "grant information",
    ),
    "author_contributions": (
        "author contributions", "authors' contributions", "credit statement", "credit author statement",
        "credit authorship contribution statement",
    ),
    "data_availability": (
        "data availability", "data availability statement", "availability of data",
    ),
    "ethics_statement": (
        "ethics statement", "ethical approval", "irb approval", "institutional review board", "research ethics",
        "informed consent",
    ),
    "conflict_of_interest": (
        "conflict of interest", "conflicts of interest", "competing interests", "competing interest",
        "declaration of interest", "declaration of competing interest", "declaration of competing interests",
    ),
    "references": (
        "references", "bibliography", "works cited", "reference list",
    ),
}

# Headings that open an appendix, and headings that are one.
APPENDIX_TRIGGERS = ("appendix", "appendices")
APPENDIX_ALIASES = (
    "supporting information", "supplementary material", "supplementary materials", "supplementary information",
    "online appendix", "electronic supplementary material",
)

# The methodology glossary, terms from Kosztyan et al. (2025), CC BY 4.0; the first three lists are
# markers of a method, the last holds terms that mark none.
QUALITATIVE_TERMS = (
    "Qualitative", "Interview", "In-depth Interviewing", "Focus Group", "Thematic Analysis", "Grounded Theory",
    "Ethnography", "Micro-Ethnography", "Ethnographic Decision Model", "Case Study", "Phenomenology",
    "Content Analysis", "Narrative Research", "Participant Observation", "Naturalistic Observation",
    "Covert Observation", "Overt Observation", "Unstructured Observation", "Triangulation", "Insiderness",
    "Cognitive Interviewing", "Focus Study", "Critical Incident Technique", "Q Methodology", "Open Question",
    "Delphi", "Expert Panel", "Expert study",
)
QUANTITATIVE_TERMS = (
    "Quantitative", "Variable", "Variance", "Regression", "Coefficient", "Likert Scale", "ANOVA", "ANCOVA",
    "Chi Square", "Chi Squared", "T Test", "Z Test", "Z Score", "Cronbach’s Alpha", "Standard Error", "P Value",
    "Correlation", "Correlational", "Factor Analysis", "Structural Equation Modeling",
    "Principal Component Analysis", "Composite Reliability", "Effect Size", "Statistic", "Statistical",
    "Standardized", "Standardization", "Confidence", "Discriminant Analysis", "Cluster Analysis",
    "Multicollinearity", "Heteroskedastic", "Probit Model", "Logit Model", "Log-Linear Analysis",
    "Loglinear Analysis", "Maximum Likelihood", "Least Squares", "Monte Carlo", "Bootstrapping",
    "Kruskal Wallis Test", "Friedman Test", "Sign Test", "Skewness", "Kurtosis", "Percentile", "Quartile",
    "Quantile", "Median", "Mean", "Mode", "Degrees of Freedom", "R Squared", "Random Effects Model",
    "Hierarchical Linear Modeling", "Generalized Linear Model", "Generalized Linear Mixed Model", "Multivariate",
    "Univariate", "Multinomial", "Path Analysis", "Sensitivity Analysis", "Type 1 Error", "Type 2 Error",
    "Type I Error", "Type II Error",
)
MIXED_TERMS = (
    "Mixed Method",
)
OTHER_TERMS = (
    "Accuracy", "Action Research", "Administrative Data", "Affective Measure", "Aggregate", "Alpha Level",
    "Anonymity", "Association", "Attrition", "Average", "Axiom", "Behavioral Categories", "Bell-Shaped Curve",
    "Benchmarking", "Beta Level", "Between-Subjects Design", "Bias", "Categorical Data", "Causal Analysis",
    "Causal Inference", "Causal Relationship", "Causality", "Ceiling", "Census", "Central Limit Theorem",
    "Central Tendency", "Chart", "Closed questions", "Cohort", "Comparability", "Confidentiality", "Consistency",
    "Constant", "Contamination", "Context Conditionality", "Context Sensitivity", "Control Group",
    "Controlled Experiment", "Controlled Observation", "Counterbalancing", "Covariable", "Covariance", "Covariate",
    "Coverage", "Cross Tabulation", "Cross-Sectional Data", "Crossover Design", "Curvilinear", "Dashboard",
    "Data Analysis", "Data Mining", "Data Reduction", "Deduction", "Deductive Method", "Dendrogram", "Deviation",
    "Dispersion", "Distribution", "Double-Barreled Question", "Double-Blind", "Duration Model", "Endogeneity",
    "Engineering Applications", "Estimation", "Evaluation Apprehension", "Event History Analysis", "Exogeneity",
    "Experimental Control", "Experimental Design", "Explanatory Analysis", "Exploratory Data Analysis",
    "Exploratory Study", "Extrapolation", "Field experiment", "Field Research", "Forecasting", "Fuzzy",
    "Game Theory", "Hawthorne Effect", "Heterogeneity", "Hierarchical Model", "Histogram", "Hypothesis",
    "Imputed Response", "Independent Group Design", "Indicator", "Indirect Effect", "Inductive Method",
    "Informed consent", "Instrument Error", "Intent to Treat", "Inter-Observer Reliability", "Interaction Effect",
    "Intercept", "Interrater reliability", "Interval", "Jackknife Technique", "Laboratory Experiment",
    "Latent Growth Model", "Link Analysis", "Main Effect", "Margin of Error", "Markov Chain", "Matched pairs", "MDS",
    "Measurement Error", "Meta-Analysis", "Missing Completely at Random", "Missing Data", "Misspecification",
    "Monotonic Trend", "Multidimensional", "Multifactor", "Mutually Exclusive", "Natural Experiment",
    "Negative Association", "Nominal", "Nonlinear", "Nonparametric", "Nonresponse Error", "Nonsampling Error",
    "Nonsignificant", "Norm", "Observed Value", "Order Effect", "Ordinal", "Outlier", "Oversampling",
    "Paired Comparison", "Panel Study", "PASTA Analysis", "PCA", "Pilot Study", "Point Estimate",
    "Positively Associated", "Power", "Precision", "Presumptive Consent", "Pretest", "Primary data", "Probability",
    "Psychometric Property", "Quasiexperiment", "Quasiexperimental", "Questionnaire", "Random Error",
    "Random Selection", "Randomization", "Range", "Rank Order", "Rate", "Rating Scale", "Ratio", "Repeated Measures",
    "Replicability", "Representativeness", "Respondent", "Response Categories", "Retrospective Consent",
    "Retrospective Look", "Rigorous Research", "Robustness", "Sample", "Sampling", "Scaled Score", "Scatter Plot",
    "Scattergram", "Scatterplot", "Scenario Analysis", "Scenario Planning", "Secondary Data",
    "Selective Observation", "Semantic Differential Scale", "Significance", "Simulation", "Single Blind", "Slope",
    "Social Desirability", "Social Network", "Sociogram", "Spurious Relationship", "Stratification",
    "Structural Model", "Structured Observation", "Subsample", "Survey Research", "Test-Retest Reliability",
    "Time Series", "Time Variant", "Time-Invariant", "Treatment Effect", "Treatment offered",
    "Treatment on the Treated", "Two-Tailed", "Typology", "Unbiased", "Unconditional Longitudinal Model",
    "Unconditional Longitudinal Study", "Undersampling", "Unfolding Question", "Unit of Analysis", "Validity",
    "Weighted Score", "Weighting", "xij", "yij",
)

UNKNOWN = "Unknown"
ROLE_NAMES = [r for r, *_ in ROLES if r != UNKNOWN]
CONTENT_CLASS = {r: c for r, c, _ in ROLES}
SCOPE = {r: s for r, _, s in ROLES}
KEYWORD_ROLE = {k: r for r, own in KEYWORDS.items() for k in own}
GLOSSARY = [
    *((t, "qualitative") for t in QUALITATIVE_TERMS),
    *((t, "quantitative") for t in QUANTITATIVE_TERMS),
    *((t, "mixed") for t in MIXED_TERMS),
    *((t, None) for t in OTHER_TERMS),
]
