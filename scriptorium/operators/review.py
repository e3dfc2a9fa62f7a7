"""The review workflow as relations: decisions over machine answers, the run's gate, and what goes back to the author.

Logs are append-only; the present state is a view of the latest row. Decisions, rejections and requests to consume or
return a run are replayed in order: a request is granted by the gate of its own time, and a decision counts unless its
run was frozen before it was made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptorium.functions.dimensions import CONTENT_CLASS, ROLE_NAMES
from scriptorium.functions.text import trim_blank
from scriptorium.operators.segmentation import content_class, context_texts, node_id, review_context


def assignable_roles(tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every role that a reviewer may assign, with how many tasks offer it and how many decisions in force assign it."""
    roles = tasks.sparkSession.createDataFrame([(r,) for r in sorted(ROLE_NAMES)], "role string")
    offered = tasks.select(F.explode("candidate_roles").alias("role")).groupBy("role").agg(F.count(F.lit(1)).alias("offered"))
    given = decisions.filter("decision = 'resolve'").groupBy(F.col("assigned_role").alias("role")).agg(F.count(F.lit(1)).alias("assigned"))
    return roles.join(offered, "role", "left").join(given, "role", "left").fillna(0, ["offered", "assigned"])


def decision_errors(decisions: DataFrame, tasks: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """decisions with error: the first rule they break, or null. A decision of no known task is an error too.

    The shortlist of a task is advice: roles beyond it are valid. nodes (node_id, run_id): a title decision that names
    a node (assigned_title_node) must name one of its own run.
    """
    rows = decisions.join(tasks.select("task_id", "review_reason", F.col("run_id").alias("_run")), "task_id", "left")
    if nodes is not None:
        known = nodes.select(F.col("node_id").alias("assigned_title_node"), F.col("run_id").alias("_run"), F.lit(True).alias("_known"))
        rows = rows.join(known, ["assigned_title_node", "_run"], "left")
    blank = lambda c: trim_blank(F.coalesce(F.col(c), F.lit(""))) == ""
    title, bare, reject = F.col("review_reason") == "title_ambiguity", F.col("review_reason") == "no_structure", F.col("decision") == "reject"
    role = F.coalesce("assigned_role", F.lit(""))
    foreign = (title & ~blank("assigned_title_node") & F.col("_known").isNull()) if nodes is not None else F.lit(False)
    error = (
        F.when(F.col("review_reason").isNull(), "unknown task")
        .when(blank("reviewer_id"), "reviewer missing")
        .when(reject & blank("comment"), "comment missing")
        .when(reject, None)
        .when(title & blank("assigned_title_text"), "title missing")
        .when(foreign, "title node of another run")
        .when(title, None)
        .when(bare & ~role.isin("", *CONTENT_CLASS), "unknown role")
        .when(~bare & ~role.isin(*ROLE_NAMES), "unknown role")
    )
    return rows.withColumn("error", error).drop("_run", "_known")


def replay(runs: DataFrame, tasks: DataFrame, decisions: DataFrame, rejections: DataFrame, requests: DataFrame) -> DataFrame:
    """Every event of each run's log in order, with the gate as it stood after the event, and what came of the event.

    decisions (decision_id, ts, task_id, decision) and rejections (rejection_id, ts, run_id) are the valid ones; requests:
    request_id, ts, run_id, asked_by and wants, `consume` or `return`. Events go by time; at one time decisions come first,
    then rejections, then requests, each by id. A request to consume is granted if the gate has passed by then, one to
    return if it is returned. The first granted request freezes the run: later decisions are refused and change nothing,
    and later requests see the frozen answers. Runs may be rejected at any time. Outcomes: `accepted`, `refused`, for
    requests also `consumed` and `returned` (this one froze the run) and `again` (a consumed run is read once more).

    Nothing is refused before the first granted request, so one pass of running counts finds it; a second pass counts
    what was accepted. A run's log is one window: it is what people wrote about one paper.
    """
    none = F.lit(None).cast("string")
    own = tasks.select("task_id", "run_id")
    said = decisions.select("task_id", "decision", "ts", F.col("decision_id").alias("id")).join(own, "task_id")
    log = said.select("run_id", "ts", F.lit(0).alias("place"), "id", F.lit("decision").alias("kind"), "task_id", "decision", none.alias("asked_by"))
    objected = rejections.select("run_id", "ts", F.lit(1), F.col("rejection_id").alias("id"), F.lit("rejection"), none, none, none)
    wanted = requests.select("run_id", "ts", F.lit(2), F.col("request_id").alias("id"), F.col("wants"), none, none, "asked_by")
    counted = runs.select("run_id").join(tasks.groupBy("run_id").agg(F.count(F.lit(1)).alias("total")), "run_id", "left").fillna(0, ["total"])
    rows = log.union(objected).union(wanted).join(counted, "run_id")

    order = ["ts", "place", "id"]
    upto = Window.partitionBy("run_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = F.lag("decision").over(Window.partitionBy("run_id", "task_id").orderBy(*order))
    is_decision, is_rejection = F.col("kind") == "decision", F.col("kind") == "rejection"
    refused = lambda c: F.coalesce(c == "reject", F.lit(False)).cast("int")
    rows = rows.withColumn("_before", before).withColumns({
        "_answered": (is_decision & F.col("_before").isNull()).cast("int"),
        "_refused": F.when(is_decision, refused(F.col("decision")) - refused(F.col("_before"))).otherwise(0),
        "_objected": is_rejection.cast("int"),
    })

    def counts(live):
        """The gate after each event, as far as live events go."""
        total = lambda c: F.sum(F.when(live, F.col(c)).otherwise(0)).over(upto)
        return {"open": F.col("total") - total("_answered"), "rejected": total("_refused"), "run_rejected": F.sum("_objected").over(upto) > 0}

    state = gate_state(F.col("run_rejected"), F.col("rejected"), F.col("open"))
    granted = ((F.col("kind") == "consume") & (F.col("state") == "passed")) | ((F.col("kind") == "return") & (F.col("state") == "returned"))
    first = F.min(F.when(granted, F.struct("ts", "id"))).over(Window.partitionBy("run_id"))
    rows = rows.withColumns(counts(F.lit(True))).withColumn("state", state).withColumn("_first", first)
    late = F.coalesce(F.col("ts") > F.col("_first.ts"), F.lit(False))
    rows = rows.withColumns(counts(~late)).withColumn("state", state)
    froze = (F.col("place") == 2) & (F.struct("ts", "id") == F.col("_first"))
    outcome = (
        F.when(is_decision, F.when(late, "refused").otherwise("accepted"))
        .when(is_rejection, "accepted")
        .when(froze, F.when(F.col("kind") == "consume", "consumed").otherwise("returned"))
        .when((F.col("kind") == "consume") & (F.col("state") == "passed"), "again")
        .otherwise("refused")
    )
    return rows.select("run_id", "ts", "kind", "id", "task_id", "decision", "asked_by", "total", "open", "rejected", "run_rejected", "state", outcome.alias("outcome"))


def freezes(replayed: DataFrame) -> DataFrame:
    """The request that froze each frozen run: run_id, consumed_at, consumed_by, request_id and how, `consumed` or `returned`."""
    rows = replayed.filter(F.col("outcome").isin("consumed", "returned"))
    return rows.select("run_id", F.col("ts").alias("consumed_at"), F.col("asked_by").alias("consumed_by"), F.col("id").alias("request_id"), F.col("outcome").alias("how"))


def frozen_out(decisions: DataFrame, tasks: DataFrame, frozen: DataFrame) -> DataFrame:
    """Decisions with their run and whether they come too late: made after the run was frozen.

    frozen: run_id, consumed_at. Decisions of no known task have no run and are left out.
    """
    own = decisions.join(tasks.select("task_id", "run_id"), "task_id").join(frozen.select("run_id", "consumed_at"), "run_id", "left")
    return own.withColumn("refused", F.coalesce(F.col("ts") > F.col("consumed_at"), F.lit(False)))


def latest_decisions(decisions: DataFrame, consumed: DataFrame | None = None) -> DataFrame:
    """The decision in force for each task: the latest one keeps the id and time of the first (an upsert of a log).

    consumed: run_id and consumed_at; decisions made later than that are dropped. decisions then need run_id.
    """
    if consumed is not None:
        decisions = decisions.join(consumed.select("run_id", "consumed_at"), "run_id", "left").filter("consumed_at is null or ts <= consumed_at").drop("consumed_at")
    rest = [c for c in decisions.columns if c not in ("task_id", "decision_id", "ts")]
    order = F.struct("ts", "decision_id")
    return decisions.groupBy("task_id").agg(
        F.min_by("decision_id", order).alias("decision_id"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        *(F.max_by(c, order).alias(c) for c in rest),
    )


def valid_rejections(rejections: DataFrame, runs: DataFrame) -> DataFrame:
    """Rejections of known runs with a reviewer and a comment."""
    said = lambda c: trim_blank(F.coalesce(F.col(c), F.lit(""))) != ""
    return rejections.filter(said("reviewer_id") & said("comment")).join(runs.select("run_id"), "run_id", "left_semi")


def first_rejections(rejections: DataFrame) -> DataFrame:
    """The first rejection of each run; later ones don't replace it."""
    order = F.struct("ts", "rejection_id")
    rest = [c for c in rejections.columns if c != "run_id"]
    return rejections.groupBy("run_id").agg(*(F.min_by(c, order).alias(c) for c in rest))


def superseded_runs(runs: DataFrame, rejections: DataFrame) -> DataFrame:
    """runs with superseded_at: the time of the run's first rejection, before or after its consumption alike."""
    first = first_rejections(valid_rejections(rejections, runs)).select("run_id", F.col("ts").alias("superseded_at"))
    return runs.join(first, "run_id", "left")


def effective_roles(nodes: DataFrame, tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """nodes with the role, class and status in force: a rejection clears the role, a decision replaces it."""
    answered = (
        tasks.filter("review_reason <> 'title_ambiguity'")
        .join(decisions.select("task_id", "decision", "assigned_role"), "task_id")
        .select(
            "paper_id",
            F.col("section_ordinal").alias("ordinal"),
            "decision",
            F.coalesce("assigned_role", F.when(F.col("review_reason") == "no_structure", "Unknown")).alias("assigned_role"),
        )
    )
    rows = nodes.join(answered, ["paper_id", "ordinal"], "left")
    rejected, given = F.col("decision") == "reject", F.col("decision").isNotNull()
    role = F.when(rejected, None).when(given, F.col("assigned_role")).otherwise(F.col("role"))
    return rows.select(
        "paper_id", "ordinal", "heading_raw", role.alias("effective_role"), F.when(rejected, None).when(given, content_class(F.col("assigned_role"))).otherwise(F.col("content_class")).alias("effective_class"),
        F.when(rejected, "reviewer_rejected").when(given, "reviewer_confirmed").otherwise(F.col("status")).alias("effective_status"), given.alias("from_review"),
    )


def effective_titles(runs: DataFrame, tasks: DataFrame, decisions: DataFrame) -> DataFrame:
    """The title in force for each run, and the node that holds it: the one that a decision names, if any."""
    named = "assigned_title_node" if "assigned_title_node" in decisions.columns else F.lit(None).cast("string").alias("assigned_title_node")
    answers = decisions.select("task_id", "decision", "assigned_title_text", named)
    own = (
        tasks.filter("review_reason = 'title_ambiguity'")
        .join(answers, "task_id")
        .drop("task_id")
        .select("run_id", "decision", "assigned_title_text", "assigned_title_node")
    )
    rejected, given = F.col("decision") == "reject", F.col("decision").isNotNull()
    machine = F.when(F.col("title_ordinal") >= 0, node_id(F.col("title_ordinal")))
    return runs.join(own, "run_id", "left").select(
        "run_id",
        F.when(given & ~rejected, F.col("assigned_title_text")).otherwise(F.col("title_text")).alias("title_text"),
        F.when(rejected, None).when(given, F.nullif("assigned_title_node", F.lit(""))).otherwise(machine).alias("title_node"),
        F.when(rejected, "reviewer_rejected").when(given, "reviewer_confirmed").otherwise(F.col("title_status")).alias("title_status"),
        F.when(given & ~rejected, "human").otherwise(F.col("title_method")).alias("title_method"),
        given.alias("from_review"),
    )


def effective_view(nodes: DataFrame, runs: DataFrame, tasks: DataFrame, decisions: DataFrame, rejections: DataFrame) -> DataFrame:
    """What a consumer of a run reads: each node with the role in force and its source, the run's title and its gate."""
    own = effective_roles(nodes, tasks, decisions).join(nodes.select("paper_id", "ordinal", "node_kind", "method"), ["paper_id", "ordinal"])
    titles = effective_titles(runs, tasks, decisions).select("run_id", "title_text", F.col("title_status"))
    states = gate(runs, tasks, decisions, rejections).select("run_id", "state")
    run = runs.select("run_id", "paper_id").join(titles, "run_id").join(states, "run_id")
    shown = (
        F.when(F.col("node_kind") == "document_title", "(document title)")
        .when(F.col("effective_status") == "reviewer_rejected", "— rejected")
        .otherwise(F.coalesce("effective_role", F.lit("— still open")))
    )
    source = F.when(F.col("from_review"), "HUMAN").otherwise(F.coalesce("method", F.lit("—")))
    return own.join(run, "paper_id").select(
        "run_id", "ordinal", "heading_raw", shown.alias("role"), "effective_class", "effective_status", source.alias("source"), "title_text", "title_status", "state"
    )


def gate_state(run_rejected, rejected, open_):
    """returned if the run or a task of it was rejected, else open while a task is, else passed."""
    return F.when(run_rejected | (rejected > 0), "returned").when(open_ > 0, "open").otherwise("passed")


def gate(runs: DataFrame, tasks: DataFrame, decisions: DataFrame, rejections: DataFrame) -> DataFrame:
    """State of each run: returned if it or a task of it was rejected, else open while a task is, else passed."""
    state = tasks.join(decisions.select("task_id", "decision"), "task_id", "left").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("decision").isNull()).alias("open"), F.count_if(F.col("decision") == "reject").alias("rejected"), F.count_if(F.col("decision") != "reject").alias("resolved")
    )
    rows = (
        runs.select("run_id")
        .join(state, "run_id", "left")
        .join(first_rejections(rejections).select("run_id", F.lit(True).alias("run_rejected")), "run_id", "left")
        .fillna(0)
        .fillna(False)
    )
    return rows.withColumn("state", gate_state(F.col("run_rejected"), F.col("rejected"), F.col("open")))


def author_return(runs: DataFrame, trees: DataFrame, tasks: DataFrame, decisions: DataFrame, rejections: DataFrame) -> DataFrame:
    """Items for the author of each returned run: the run's own rejection first, then rejected tasks in their order."""
    first = first_rejections(rejections).join(runs.select("run_id"), "run_id")
    text, none = F.lit(None).cast("string"), F.array().cast("array<string>")
    whole = first.select(
        "run_id",
        F.lit(-1).alias("place"),
        text.alias("task_id"),
        F.lit("run_rejected").alias("review_reason"),
        text.alias("heading_raw"),
        none.alias("ancestors"),
        "comment",
    )
    asked = tasks.join(decisions.filter("decision = 'reject'").select("task_id", "comment"), "task_id").join(
        review_context(trees).select("paper_id", F.col("ordinal").alias("section_ordinal"), "heading_raw", "ancestors"), ["paper_id", "section_ordinal"], "left"
    )
    own = asked.select(
        "run_id",
        F.col("task_ordinal").alias("place"),
        "task_id",
        "review_reason",
        "heading_raw",
        F.coalesce("ancestors", none).alias("ancestors"),
        "comment",
    )
    order = Window.partitionBy("run_id").orderBy("place")
    return whole.unionByName(own).withColumn("position", F.row_number().over(order) - 1).drop("place")


def return_snapshot(items: DataFrame, frozen: DataFrame) -> DataFrame:
    """The reports to authors as they were when the return was granted, with their items frozen in them.

    items: `author_return` of the decisions in force and of the rejections made by then (`rejections_by`); frozen:
    `freezes`. A run has one report at most: whatever is asked for later finds it frozen.
    """
    granted = frozen.filter("how = 'returned'").select(F.col("request_id").alias("return_id"), "run_id", F.col("consumed_by").alias("returned_by"), "consumed_at")
    return granted.join(items, "run_id").select(
        "return_id", "run_id", "returned_by", "consumed_at", "position", "task_id", "review_reason", "heading_raw", "ancestors", "comment"
    )


def rejections_by(rejections: DataFrame, frozen: DataFrame) -> DataFrame:
    """Rejections of runs made before the run was frozen, or at that time."""
    known = rejections.join(frozen.select("run_id", "consumed_at"), "run_id", "left")
    return known.filter("consumed_at is null or ts <= consumed_at").drop("consumed_at")


def consumed_runs(frozen: DataFrame) -> DataFrame:
    """Runs whose decisions were consumed: the first time that it was asked for while the gate had passed, and by whom."""
    return frozen.filter("how = 'consumed'").select("run_id", "consumed_at", "consumed_by")


def review_items(tasks: DataFrame, decisions: DataFrame, trees: DataFrame, runs: DataFrame, papers: DataFrame) -> DataFrame:
    """Tasks with their decision, context and the text that it covers, for runs whose markdown still has the hash that
    they were made from.

    A task about the whole document (section -1) has no context: no ancestors, a null heading and a null text. The text
    of a context is cut in its paper's row by the span that its tree has, and only where a task asks for it.
    """
    now = papers.select("paper_id", F.sha2(F.coalesce("markdown", F.lit("")).cast("binary"), 256).alias("_hash"))
    same = runs.join(now, "paper_id").filter("markdown_hash = _hash").select("run_id")
    contexts = review_context(trees)
    context = contexts.select("paper_id", F.col("ordinal").alias("section_ordinal"), "heading_raw", "ancestors")
    wanted = tasks.select("paper_id", F.col("section_ordinal").alias("ordinal"))
    shown = context_texts(contexts, wanted, papers).select("paper_id", F.col("ordinal").alias("section_ordinal"), "text")
    asked = tasks.join(same, "run_id", "left_semi").join(decisions.select("task_id", "decision", "assigned_role"), "task_id", "left")
    places = ["paper_id", "section_ordinal"]
    items = asked.join(context, places, "left").join(shown, places, "left")
    return items.withColumn("ancestors", F.coalesce("ancestors", F.array().cast("array<string>")))
