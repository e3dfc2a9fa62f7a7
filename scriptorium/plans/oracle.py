"""SQL for DuckDB that answers the registered queries on its own: another formulation over the same generated corpus."""

from __future__ import annotations

import re

from scriptorium.functions.dimensions import APPENDIX_ALIASES, CONTENT_CLASS, GLOSSARY, KEYWORD_ROLE, ROLE_NAMES, SCOPE
from scriptorium.operators.ingest import LATENCY_BOUNDS
from scriptorium.operators.methodology import LEAST_MARKERS, MARGIN, folded
from scriptorium.plans.corpus import DUCK
from scriptorium.plans.queries import IDENTIFIED
from scriptorium.plans.registry import ORACLE_SQL


def quoted(x: str | None) -> str:
    return "null" if x is None else "'" + x.replace("'", "''") + "'"


def values(rows, columns: str) -> str:
    return f"(values {', '.join('(' + ', '.join(map(quoted, r)) + ')' for r in rows)}) as v({columns})"


WORD = r"[\p{L}\p{Nd}_]"
SPACE = r"[\t\n\f\r ]"


def escaped(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " and c.isascii() else c for c in s)


def doubled(s: str) -> str:
    """Every character that is no part of a word twice, as the text is: touching matches then share no character."""
    return "".join(c if c.isalnum() or c == "_" else c + c for c in s)


def count_of(entry: tuple[str, str | None]) -> str:
    """How often a term stands in the doubled text, by a pattern that is constant and so compiled once."""
    term, marker = entry
    inner = doubled(folded(term))
    pattern = rf"(?:^|[^\p{{L}}\p{{Nd}}_]){escaped(inner)}s?(?:$|[^\p{{L}}\p{{Nd}}_])"
    return f"{{term: {quoted(term)}, marker: {quoted(marker)}::varchar, hits: case when contains(text, {quoted(inner)}) then len(regexp_extract_all(text, {quoted(pattern)})) else 0 end}}"


STEPS: dict[str, str] = {
    "papers": DUCK.papers(),
    "landed": DUCK.landed(),
    "responses": DUCK.responses(),
    "decisions": DUCK.decisions(),
    "rejections": DUCK.rejections(),
    "requests": DUCK.requests(),
    "mentions": DUCK.mentions(),
    # -- methodology
    "doubled": rf"select paper_id, strlen(markdown) as size, regexp_replace(lower(replace(markdown, '’', '''')), '([^\p{{L}}\p{{Nd}}_])', '\1\1', 'g') as text from papers",
    "fired": f"select * from (select paper_id, unnest([{', '.join(map(count_of, GLOSSARY))}], recursive := true) from doubled) where hits > 0",
    "counted": """select p.paper_id, strlen(p.markdown) as size, coalesce(sum(hits) filter (marker = 'qualitative'), 0)::bigint as qualitative_hits, coalesce(sum(hits) filter (marker = 'quantitative'), 0)::bigint as quantitative_hits,
        count(*) filter (marker in ('qualitative', 'quantitative')) as distinct_markers, coalesce(bool_or(marker = 'mixed'), false) as mixed_flag, count(term) as distinct_terms, coalesce(sum(hits), 0)::bigint as total_occurrences
        from papers p left join fired f using (paper_id) group by p.paper_id, p.markdown""",
    "scored": "select *, case when qualitative_hits + quantitative_hits > 0 then (quantitative_hits - qualitative_hits)::double / (qualitative_hits + quantitative_hits) else 0.0 end as score from counted",
    "methods": f"""select * exclude (size), case when distinct_markers < {LEAST_MARKERS} or qualitative_hits + quantitative_hits = 0 then null when score > {MARGIN} then 'quantitative' when score < -{MARGIN} then 'qualitative' end as methodology_class,
        qualitative_hits::double / size * 10000 as qualitative_rate, quantitative_hits::double / size * 10000 as quantitative_rate from scored""",
    # -- lines and headings
    "cut": "select paper_id, strlen(markdown) as size, string_split(markdown, chr(10)) as l from papers",
    "numbered": "select paper_id, size, unnest(l) as line, unnest(range(0, len(l))) as place from cut",
    "lines": rf"""select *, coalesce(sum(strlen(line) + 1) over (partition by paper_id order by place rows between unbounded preceding and 1 preceding), 0)::bigint as start,
        regexp_replace(line, '^\s+|\s+$', '', 'g') as bare from numbered""",
    "masked": r"""select *, coalesce(sum((regexp_matches(line, '^ {0,3}```'))::int) over w, 0) % 2 + coalesce(sum((regexp_matches(line, '^ {0,3}\$\$'))::int) over w, 0) % 2 as hidden from lines
        window w as (partition by paper_id order by place rows between unbounded preceding and 1 preceding)""",
    "marked": r"""select *, regexp_extract(line, '^( {0,3})(#{1,6})([ \t]*)(.*)$', ['lead', 'marks', 'gap', 'rest']) as m from masked where hidden = 0 and regexp_matches(line, '^ {0,3}#{1,6}([ \t]|$)')""",
    "detected": r"""select paper_id, size, length(m.marks) as level, start + length(m.lead) as byte_start, regexp_replace(regexp_replace(m.rest, '([ \t]+|^)#+[ \t]*$', ''), '[ \t]+$', '') as text,
        start + strlen(m.lead) + strlen(m.marks) + strlen(m.gap) as first, start + strlen(line) as span_start from marked""",
    "nonblank": r"""select *, regexp_matches(line, '\((19|20)\d{2}[a-z]?\)|\b(19|20)\d{2}[a-z]?\.') as entry from lines where bare <> ''""",
    "counted_entries": "select *, sum(entry::int) over (partition by paper_id order by place rows between 1 following and 25 following) as entries from nonblank",
    "referenced": rf"""select paper_id, max_by({{start: start, line: line}}, place) as r from counted_entries
        where regexp_matches(line, '(?i)^\s*(?:\d+\.?\s*)?(reference list|bibliography|works cited|references)\s*:?\s*$') and entries >= 3 group by paper_id""",
    "inferred": """select r.paper_id, any_value(c.size) as size, coalesce(min(d.level) filter (d.level between 2 and 4), 2) as level, any_value(r.r.start) as byte_start, any_value(r.r.line) as text, any_value(r.r.start) as first,
        any_value(r.r.start + strlen(r.r.line)) as span_start from referenced r join cut c using (paper_id) left join detected d using (paper_id) group by r.paper_id""",
    "headings": """select paper_id, size, level, byte_start, case when text = '' then byte_start else first end as text_start, case when text = '' then byte_start else first + strlen(text) end as text_stop, span_start, false as inferred, text from detected
        union all select paper_id, size, level, byte_start, byte_start, byte_start + strlen(text), span_start, true, text from inferred""",
    # -- classification of distinct headings
    "texts": "select distinct text as heading_raw from headings",
    "normal": rf"select heading_raw, regexp_replace(regexp_replace(lower(regexp_replace(heading_raw, '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g'), '[:. ]+$', '') as heading_normalized from texts",
    "stripped": r"""select *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(heading_normalized, '^section\s+\d+[a-z]?\s*[:.\-]\s*', ''), '^\d+(\.\d+)*\s*[.:\-]?\s+', ''), '^[ivxlcdm]+\s*[.)]\s+', ''), '^[a-z]\s*[.)]\s+', ''),
        '^[:. ]+|[:. ]+$', '', 'g')) as stripped from normal""",
    "rested": rf"""select *, case when stripped in ({", ".join(map(quoted, APPENDIX_ALIASES))}) then '' when starts_with(stripped, 'appendix') then trim(substr(stripped, 9)) when starts_with(stripped, 'appendices') then trim(substr(stripped, 11)) end as rest from stripped""",
    "boxed": r"""select *, case when rest is not null then 'appendix' end as container, case when regexp_matches(rest, '^([A-Za-z0-9]{1,3})\b\s*([:.\-]\s*)?(.*)$') then upper(regexp_extract(rest, '^[A-Za-z0-9]{1,3}')) end as label,
        case when rest is null then stripped when regexp_matches(rest, '^([A-Za-z0-9]{1,3})\b\s*([:.\-]\s*)?(.*)$') then trim(regexp_extract(rest, '^([A-Za-z0-9]{1,3})\b\s*([:.\-]\s*)?(.*)$', 3), ' :.-') else trim(rest, ' :.-') end as remainder from rested""",
    "keywords": f"select * from {values(KEYWORD_ROLE.items(), 'keyword, role')}",
    "classes": f"select * from {values(CONTENT_CLASS.items(), 'role, content_class')}",
    "semantics": "select distinct remainder as s from boxed where remainder <> '' and remainder not in (select keyword from keywords)",
    "places": "select s, keyword, role, unnest(range(1, length(s) - length(keyword) + 2)) as i from semantics, keywords where contains(s, keyword)",
    "occurrences": rf"""select s, keyword, role, strlen(substr(s, 1, i - 1)) as b, strlen(substr(s, 1, i - 1)) + strlen(keyword) as e from places
        where substr(s, i, length(keyword)) = keyword and not regexp_matches(case when i > 1 then substr(s, i - 1, 1) else '' end, '{WORD}') and not regexp_matches(substr(s, i + length(keyword), 1), '{WORD}')""",
    "suppressed": """select o.s, o.keyword, o.role, o.b, o.e, arg_min(x.keyword, (x.b, -x.e, x.keyword)) as suppressed_by from occurrences o
        left join occurrences x on x.s = o.s and x.b <= o.b and o.e <= x.e and x.e - x.b > o.e - o.b group by all""",
    "live": "select s, list_sort(list_distinct(list(role))) as roles, list_sort(list_distinct(list(keyword))) as words from suppressed where suppressed_by is null group by s",
    "judged": """select b.*, case when container is not null or remainder = '' then 'Unknown' when k.role is not null then k.role when len(roles) = 1 then roles[1] end as role,
        case when container is not null or remainder = '' then 'structural' when k.role is not null or len(roles) = 1 then 'rule' end as method,
        case when container is null and len(roles) > 1 then roles else [] end as candidates, case when container is not null then [] when k.role is not null then [remainder] else coalesce(words, []) end as matched
        from boxed b left join keywords k on k.keyword = b.remainder left join live on live.s = b.remainder""",
    # -- the tree
    "kept": "select *, row_number() over w - 1 as ordinal, coalesce(lead(byte_start) over w, size) as end_offset from headings where level <= 4 window w as (partition by paper_id order by byte_start)",
    "plain": """select k.*, j.* exclude (heading_raw), c.content_class from kept k join judged j on j.heading_raw = k.text left join classes c on c.role = j.role""",
    "firsts": "select paper_id, count(*) filter (level = 1) as h1, min(ordinal) filter (level = 1) as first_h1, min(level) as shallowest, arg_min({level: level, container: container, remainder: remainder}, ordinal) as head from plain group by paper_id",
    "titles": """select f.paper_id, h1, case when first_h1 is not null and coalesce(p.method, '') <> 'rule' then first_h1 else -1 end as title_ordinal, case when h1 = 0 and head.level = shallowest and head.container is null and head.remainder not in (select keyword from keywords) then 0 else -1 end as candidate
        from firsts f left join plain p on p.paper_id = f.paper_id and p.ordinal = f.first_h1""",
    "titled": """select p.*, title_ordinal, candidate, ordinal = title_ordinal as is_title, case when ordinal = title_ordinal or ordinal = candidate then null else p.role end as role1, case when ordinal = title_ordinal then 'administrative' when ordinal = candidate then null else p.content_class end as class1,
        case when ordinal = title_ordinal then 'structural' when ordinal = candidate then null else p.method end as method1, case when ordinal in (title_ordinal, candidate) then [] else candidates end as candidates1, case when ordinal in (title_ordinal, candidate) then [] else matched end as matched1
        from plain p join titles using (paper_id)""",
    "linked": "select t.*, coalesce((select max(u.ordinal) from titled u where u.paper_id = t.paper_id and u.ordinal < t.ordinal and u.level < t.level), -1) as parent from titled t",
    "walk": """select paper_id, ordinal, parent as at from linked where method1 is null and len(candidates1) = 0
        union all select w.paper_id, w.ordinal, l.parent from walk w join linked l on l.paper_id = w.paper_id and l.ordinal = w.at where l.method1 is null and len(l.candidates1) = 0 and not l.is_title""",
    "ends": "select w.paper_id, w.ordinal, any_value(l.role1) as role, any_value(l.class1) as class from walk w join linked l on l.paper_id = w.paper_id and l.ordinal = w.at where l.method1 is not null and not l.is_title group by all",
    "heired": "select l.*, case when e.role is not null then e.role else role1 end as role2, case when e.role is not null then e.class else class1 end as class2, case when e.role is not null then 'inherited' else method1 end as method2 from linked l left join ends e using (paper_id, ordinal)",
    "children": "select paper_id, parent as ordinal, count(*) as n, bool_and(coalesce(method2, '') = 'rule' and coalesce(role2, 'Unknown') <> 'Unknown') as ruled, min(role2) as low, max(role2) as high from heired where parent >= 0 group by all having n >= 2 and ruled and low = high",
    "grown": """select g.*, case when agreed then g.low else role2 end as role3, case when agreed then k.content_class else class2 end as class3, case when agreed then 'child_consensus' else method2 end as method3
        from (select h.*, c.low, method2 is null and len(candidates1) = 0 and not is_title and h.ordinal <> candidate and c.n is not null as agreed from heired h left join children c using (paper_id, ordinal)) g left join classes k on k.role = g.low""",
    "nodes": """select paper_id, ordinal, parent as parent_ordinal, level as heading_level, case when inferred then 'inferred' else 'detected' end as heading_source, case when is_title then 'document_title' else 'section' end as node_kind, text as heading_raw, case when not is_title then remainder end as semantic_heading,
        container as structural_container, label as appendix_label, span_start as start_offset, end_offset, role3 as role, class3 as content_class, case when method3 is null then 'unresolved' else 'resolved' end as status, method3 as method, candidates1 as candidate_roles, matched1 as matched_keywords from grown
        union all select paper_id, 0, -1, 0, null, 'section', null, null, null, null, 0, size, 'Unknown', 'analytical', 'resolved', 'structural', [], [] from cut where paper_id not in (select paper_id from kept)""",
    "runs": """select c.paper_id, c.paper_id || '@2.9' as run_id, coalesce(t.title_ordinal, -1) as title_ordinal, coalesce(t.candidate, -1) as candidate, case when coalesce(t.title_ordinal, -1) >= 0 then 'identified' else 'unresolved' end as title_status,
        case when coalesce(t.title_ordinal, -1) >= 0 then case when h1 = 1 then 'singleton_h1' else 'structural_rule' end end as title_method, n.heading_raw as title_text from cut c left join titles t using (paper_id) left join nodes n on n.paper_id = c.paper_id and n.ordinal = t.title_ordinal""",
    "asked": """select n.paper_id, 0 as part, ordinal as section_ordinal, case when len(candidate_roles) > 0 then 'multi_role_match' else 'zero_role_match' end as review_reason, candidate_roles, matched_keywords from nodes n join runs r using (paper_id) where n.status = 'unresolved' and ordinal <> candidate
        union all select paper_id, 1, 0, 'no_structure', [], [] from nodes where heading_level = 0 union all select paper_id, 2, candidate, 'title_ambiguity', [], [] from runs where title_ordinal < 0""",
    "tasks": "select paper_id || '@2.9' as run_id, *, paper_id || '/' || task_ordinal as task_id from (select *, row_number() over (partition by paper_id order by part, section_ordinal) - 1 as task_ordinal from asked)",
    # -- review
    "checked": f"""select d.*, case when t.task_id is null then 'unknown task' when trim(coalesce(reviewer_id, '')) = '' then 'reviewer missing' when decision = 'reject' and trim(coalesce(comment, '')) = '' then 'comment missing' when decision = 'reject' then 'valid'
        when review_reason = 'title_ambiguity' then case when trim(coalesce(assigned_title_text, '')) = '' then 'title missing'
            when assigned_title_node is not null and not exists (select 1 from nodes n where n.paper_id = t.paper_id and n.paper_id || '@2.9#' || n.ordinal = assigned_title_node) then 'title node of another run' else 'valid' end when review_reason = 'no_structure' and coalesce(assigned_role, '') in ('', {", ".join(map(quoted, CONTENT_CLASS))}) then 'valid'
        when review_reason <> 'no_structure' and assigned_role in ({", ".join(map(quoted, ROLE_NAMES))}) then 'valid' else 'unknown role' end as outcome, t.review_reason, t.run_id, t.paper_id, t.section_ordinal, t.task_ordinal from decisions d left join tasks t using (task_id)""",
    "refused": "select * from (select *, row_number() over (partition by run_id order by ts, rejection_id) as n from rejections where trim(coalesce(comment, '')) <> '' and trim(coalesce(reviewer_id, '')) <> '' and run_id in (select run_id from runs)) where n = 1",
    "questions": "select r.run_id, count(t.task_id) as total from runs r left join tasks t using (run_id) group by r.run_id",
    "answered": "select q.request_id, c.task_id, arg_max(c.decision, (c.ts, c.decision_id)) as decision from requests q join checked c on c.run_id = q.run_id and c.outcome = 'valid' and c.ts <= q.ts group by all",
    "met": """select q.*, any_value(n.total) - count(a.task_id) as open, count(*) filter (a.decision = 'reject') as rejected, coalesce(bool_or(x.ts <= q.ts), false) as run_rejected
        from requests q join questions n using (run_id) left join answered a using (request_id) left join refused x on x.run_id = q.run_id group by all""",
    "froze": """select run_id, min(ts) as frozen_at, arg_min(request_id, (ts, request_id)) as request_id, arg_min(asked_by, (ts, request_id)) as asked_by, arg_min(wants, (ts, request_id)) as wants from met
        where case when wants = 'return' then run_rejected or rejected > 0 else not run_rejected and rejected = 0 and open = 0 end group by run_id""",
    "intime": "select c.*, coalesce(c.ts > f.frozen_at, false) as late from checked c left join froze f on f.run_id = c.run_id",
    "answered_in_time": "select q.request_id, c.task_id, arg_max(c.decision, (c.ts, c.decision_id)) as decision from requests q join intime c on c.run_id = q.run_id and c.outcome = 'valid' and not c.late and c.ts <= q.ts group by all",
    "met_in_time": """select q.*, any_value(n.total) - count(a.task_id) as open, count(*) filter (a.decision = 'reject') as rejected, coalesce(bool_or(x.ts <= q.ts), false) as run_rejected
        from requests q join questions n using (run_id) left join answered_in_time a using (request_id) left join refused x on x.run_id = q.run_id group by all""",
    "placed": "select *, row_number() over (partition by task_id order by ts desc, decision_id desc) as n, first_value(decision_id) over (partition by task_id order by ts, decision_id) as first_id from intime where outcome = 'valid' and not late",
    "inforce": "select * from placed where n = 1",
    "states": """select r.run_id, r.paper_id, count(t.task_id) as total, count(t.task_id) filter (d.decision is null) as open, count(*) filter (d.decision = 'reject') as rejected, count(*) filter (d.decision = 'resolve') as resolved, bool_or(x.run_id is not null) as run_rejected
        from runs r left join tasks t using (run_id) left join inforce d on d.task_id = t.task_id left join refused x on x.run_id = r.run_id group by all""",
    "climb": """select paper_id, ordinal, parent_ordinal as at, []::varchar[] as above from nodes union all select c.paper_id, c.ordinal, n.parent_ordinal, list_prepend(n.heading_raw, c.above) from climb c join nodes n on n.paper_id = c.paper_id and n.ordinal = c.at""",
    "contexts": """select n.paper_id, n.ordinal, n.heading_raw, array_to_string(c.above, '|') as ancestors, n.start_offset,
        (select max(u.end_offset) from nodes u where u.paper_id = n.paper_id and u.ordinal >= n.ordinal and u.ordinal < coalesce((select min(v.ordinal) from nodes v where v.paper_id = n.paper_id and v.ordinal > n.ordinal and v.heading_level <= n.heading_level), 1000000)) as end_offset
        from nodes n join climb c on c.paper_id = n.paper_id and c.ordinal = n.ordinal and c.at = -1""",
    "gate_states": "select run_id, paper_id, total, open, rejected, resolved, run_rejected, case when run_rejected or rejected > 0 then 'returned' when open > 0 then 'open' else 'passed' end as state from states",
    "noded": """select n.paper_id, n.ordinal, n.heading_raw, n.node_kind, n.method, case when d.decision = 'reject' then null when d.decision is not null then coalesce(d.assigned_role, 'Unknown') else n.role end as effective_role,
        case when d.decision = 'reject' then null when d.decision is not null then k.content_class else n.content_class end as effective_class, case when d.decision = 'reject' then 'reviewer_rejected' when d.decision is not null then 'reviewer_confirmed' else n.status end as effective_status, d.decision is not null as from_review
        from nodes n left join inforce d on d.paper_id = n.paper_id and d.section_ordinal = n.ordinal and d.review_reason <> 'title_ambiguity' left join classes k on k.role = coalesce(d.assigned_role, 'Unknown')""",
    "title_views": """select r.run_id, r.paper_id, case when d.decision = 'resolve' then d.assigned_title_text else r.title_text end as title_text,
        case when d.decision = 'resolve' then d.assigned_title_node when d.decision is null and r.title_ordinal >= 0 then r.run_id || '#' || r.title_ordinal end as title_node,
        case when d.decision = 'reject' then 'reviewer_rejected' when d.decision is not null then 'reviewer_confirmed' else r.title_status end as title_status,
        case when d.decision = 'resolve' then 'human' else r.title_method end as title_method, d.decision is not null as from_review from runs r left join inforce d on d.run_id = r.run_id and d.review_reason = 'title_ambiguity'""",
    "returns": """select run_id, row_number() over (partition by run_id order by place) - 1 as position, task_id, review_reason, heading_raw, ancestors, comment from (
        select r.run_id, -1 as place, null as task_id, 'run_rejected' as review_reason, null as heading_raw, '' as ancestors, x.comment from runs r join refused x using (run_id)
        union all select d.run_id, d.task_ordinal, d.task_id, d.review_reason, c.heading_raw, coalesce(c.ancestors, ''), d.comment from inforce d left join contexts c on c.paper_id = d.paper_id and c.ordinal = d.section_ordinal where d.decision = 'reject')""",
    "reported": """select f.request_id as return_id, f.run_id, f.asked_by as returned_by, f.frozen_at as consumed_at, row_number() over (partition by f.run_id order by place) - 1 as position, i.review_reason, i.heading_raw, i.ancestors, i.comment from froze f join (
        select run_id, -1 as place, 'run_rejected' as review_reason, null as heading_raw, '' as ancestors, comment, ts from refused
        union all select d.run_id, d.task_ordinal, d.review_reason, c.heading_raw, coalesce(c.ancestors, ''), d.comment, d.ts from inforce d left join contexts c on c.paper_id = d.paper_id and c.ordinal = d.section_ordinal where d.decision = 'reject')
        i on i.run_id = f.run_id and i.ts <= f.frozen_at where f.wants = 'return'""",
    # -- research units
    "labelled": r"select *, '(?i)\b(stud(?:y|ies)|experiments?|phases?|samples?|datasets?|data sets?|waves?|rounds?)\s+([0-9]{1,2}[A-Za-z]?|[IVX]{1,4})\b' as p from (select paper_id, ordinal, heading_raw as found_in, true as in_heading from nodes where heading_raw is not null union all select paper_id, place, line, false from lines where not starts_with(ltrim(line, ' '), '#'))",
    "named": """select paper_id, ordinal, found_in, in_heading, unnest(regexp_extract_all(found_in, p, 1)) as k, upper(unnest(regexp_extract_all(found_in, p, 2))) as label, unnest(range(0, len(regexp_extract_all(found_in, p)))) as i from labelled where regexp_matches(found_in, p)""",
    "evidence": """select *, case when lower(k) like 'stud%' then 'study' when lower(k) like 'exp%' then 'experiment' when lower(k) like 'ph%' then 'phase' when lower(k) like 'sam%' then 'sample' when lower(k) like 'data%' then 'dataset' when lower(k) like 'wave%' then 'wave' else 'round' end as kind,
        coalesce(nullif(regexp_extract(label, '^[0-9]+'), ''), label) as study_group from named""",
    "groups": """select p.paper_id, list_distinct(list(study_group) filter (in_heading and kind in ('study', 'experiment'))) as strong, list_distinct(list(study_group) filter (in_heading and kind not in ('study', 'experiment'))) as weak, list_distinct(list(study_group) filter (not in_heading and kind in ('study', 'experiment'))) as body
        from papers p left join evidence e using (paper_id) group by p.paper_id""",
    "several": "select paper_id, coalesce(strong, []) as strong, coalesce(weak, []) as weak, case when len(coalesce(strong, [])) >= 2 then [] else coalesce(body, []) end as body from groups",
    "deciding": """select *, case when len(strong) >= 2 then strong when len(body) >= 2 then body when len(weak) >= 2 then weak else [] end as labels, case when len(strong) >= 2 then 'headings' when len(body) >= 2 then 'text' when len(weak) >= 2 then 'numbered parts' else 'none' end as decided_by from several""",
    "scopes": f"select * from {values(SCOPE.items(), 'role, scope')}",
    "gates": """select paper_id, '1.0' as rule_version, case decided_by when 'headings' then 'multi' when 'none' then 'single' else 'uncertain' end as verdict, len(strong) as study_count,
        array_to_string(list_transform(list_sort(list_transform(labels, lambda x: {n: case when try_cast(x as int) is null then 1 else 0 end, i: coalesce(try_cast(x as int), 0), l: x})), lambda s: s.l), ', ') as labels, decided_by,
        len(list_distinct(list_concat(strong, body))) > greatest(len(strong), len(body)) as split_groups from deciding""",
    # -- paper types
    "answers": r"""select *, case when contains(raw_response, '<verdict>') then regexp_extract(raw_response, '<verdict>(.*?)</verdict>', 1) end as tag, regexp_replace(regexp_extract(raw_response, '(?s)<answer>(.*?)</answer>', 1), '^```(json)?\s*|\s*```$', '', 'g') as body from responses""",
    "readable": "select *, json_valid(body) as whole, case when json_valid(body) then body::json end as j from answers",
    "fields": """select *, j->>'primary_type' as primary_type, coalesce(j->>'subtype', '') as subtype, coalesce(j->>'secondary_type', '') as secondary_type, (j->>'decision_rule')::int as rule, j->>'confidence' as confidence, j->'$.evidence[*].quote' as quotes, json_extract_string(j, '$.evidence[*].quote') as texts, json_extract_string(j, '$.counter_evidence.quote') as counter, coalesce(j->>'unclassified_reason', '') as unclassified from readable""",
    "verdicts": """select *, case when tag is null then 'no <verdict> block' when not whole then 'invalid JSON' when tag <> primary_type then 'verdict tag differs from primary_type' when rule not between 1 and 5 then 'decision_rule out of range' when confidence not in ('high', 'medium', 'low') then 'unknown confidence'
        when primary_type in ('B', 'D') and subtype = '' then 'subtype missing' when primary_type not in ('B', 'D') and subtype <> '' then 'subtype not allowed' when (subtype in ('systematic_review', 'meta_analysis') and primary_type <> 'B') or (subtype in ('mathematical_modelling', 'mathematical_proof') and primary_type <> 'D') then 'subtype of another type'
        when secondary_type <> '' and secondary_type = primary_type then 'secondary_type equals primary_type' when len(texts) not between 2 and 4 then 'number of quotes' when len(list_filter(texts, lambda t: trim(t) = '')) > 0 then 'empty quote' when trim(counter) = '' then 'empty counter quote' else 'valid' end as outcome from fields""",
    "folded": "select paper_id, trim(regexp_replace(replace(translate(markdown, '‘’ʼ´`“”„‐‑‒–—―−', '''''''''''\"\"\"-------'), '…', '...'), '[\\s\\x0B \u0085]+', ' ', 'g')) as text from papers",
    "quotes": """select v.*, len(texts) as quotes_expected, len(list_filter(texts, lambda q: trim(regexp_replace(q, '\\s+', ' ', 'g')) <> '' and contains(f.text, trim(regexp_replace(q, '\\s+', ' ', 'g'))))) as quotes_verified,
        case when counter is not null then contains(f.text, trim(regexp_replace(counter, '\\s+', ' ', 'g'))) end as counter_verified, primary_type = 'A' or secondary_type = 'A' as empirical from verdicts v join folded f using (paper_id) where outcome = 'valid'""",
    # -- ingest
    "arrived": "select l.*, case when l.paper_id % 29 <> 7 then p.markdown end as markdown from landed l join papers p using (paper_id)",
    "staged": r"""select *, case when status = 'ready' then trim(regexp_extract(titled, '^\s*# (.*)$', 1)) end as title from (select *, case when error is not null then 'failed' when markdown is not null then 'ready' when started then 'processing' else 'pending' end as status,
        list_filter(string_split(markdown, chr(10))[1:10], lambda x: regexp_matches(x, '^\s*# '))[1] as titled from arrived)""",
    # -- exhibits
    "piped": "select *, length(bare) > 2 and starts_with(bare, '|') and ends_with(bare, '|') as pipe, least(size, start + strlen(line) + 1) as stop from lines",
    "opened": "select *, sum((pipe and not coalesce(was, false))::int) over (partition by paper_id order by place) as block from (select *, lag(pipe) over (partition by paper_id order by place) as was from piped)",
    "filled": "select *, row_number() over (partition by paper_id order by place) as f from opened where bare <> ''",
    "blocks": "select paper_id, block, min(place) as first_place, min(f) as f, count(*) as n, min(start) as start, max(stop) as stop, arg_min(line, place) as first_line, list(line order by place) as body from filled where pipe group by all",
    "joined": "select b.*, regexp_matches(first_line, '(?i)continued') or coalesce(regexp_matches(p.line, '(?i)continued') or p.pipe, false) as continuation from blocks b left join filled p on p.paper_id = b.paper_id and p.f = b.f - 1",
    "tabled": "select *, sum((not continuation)::int) over (partition by paper_id order by block) as t from joined",
    "captions": r"""select *, regexp_matches(line, '^\s*(?:\[\^\d+\])?\s*(?:\*\*)?\s*(Table|TABLE|Tab\.|Appendix|APPENDIX)\s*\.?\s*([A-Z]?\d+|[IVXLC]+)\b\.?\s*(?:\*\*)?\s*(.*)$') as named, regexp_extract(line, '^\s*(?:\[\^\d+\])?\s*(?:\*\*)?\s*(Table|TABLE|Tab\.|Appendix|APPENDIX)\s*\.?\s*([A-Z]?\d+|[IVXLC]+)\b\.?\s*(?:\*\*)?\s*(.*)$', ['word', 'label', 'rest']) as c,
        regexp_matches(line, '^\s{0,3}#{1,6}\s') as heading from filled""",
    "above": """select b.paper_id, b.block, arg_max({f: x.f, start: x.start, label: x.c.label, word: x.c.word, rest: trim(x.c.rest)}, x.f) as hit from tabled b join captions x on x.paper_id = b.paper_id and x.f between b.f - 3 and b.f - 1 and x.named
        where not exists (select 1 from captions h where h.paper_id = b.paper_id and h.heading and h.f between x.f and b.f - 1) and not b.continuation group by all""",
    "cells": r"""select *, list_transform(body, lambda r: list_transform(string_split(regexp_replace(regexp_replace(trim(r), '^\|', ''), '\|$', ''), '|'), lambda x: trim(x))) as grid, list_transform(body, lambda r: regexp_matches(r, '^\s*\|[|:\- ]*\|\s*$')) as rule from tabled""",
    "firstcell": r"""select *, case when not continuation and len(list_filter(grid[1][2:], lambda x: x <> '')) = 0 and regexp_matches(grid[1][1], '^(Table|TABLE|Tab\.|Appendix|APPENDIX)\s*\.?\s*([A-Z]?\d+|[IVXLC]+)\b') then regexp_extract(grid[1][1], '^(Table|TABLE|Tab\.|Appendix|APPENDIX)\s*\.?\s*([A-Z]?\d+|[IVXLC]+)\b\.?\s*(.*)$', ['word', 'label', 'rest']) end as own from cells""",
    "bodies": "select *, case when own is not null then grid[2:] else grid end as g, case when own is not null then rule[2:] else rule end as r, case when own is not null then body[2:] else body end as bl from firstcell",
    "shaped": """select b.*, a.hit, not continuation and len(g) >= 2 and r[2] as headed, list_transform(list_filter(list_zip(g, r), lambda z: not z[2]), lambda z: z[1]) as kept from bodies b left join above a using (paper_id, block)""",
    "rowed": """select *, case when headed then kept[2:] else kept end as table_rows from shaped""",
    "tables": """select m.paper_id, m.t, case when lower(coalesce(own.word, hit.word)) = 'appendix' then 'appendix' else 'table' end as kind, coalesce(own.label, hit.label) as label,
        case when own is not null then own.rest when hit.rest = '' then (select string_agg(x.bare, ' ' order by x.f) from captions x where x.paper_id = m.paper_id and x.f > m.hit.f and x.f < m.f) else hit.rest end as caption,
        case when own is not null then 'first_cell' when hit is not null then 'above' else 'none' end as caption_source, headed as has_header, len(list_filter(bl, lambda x: contains(x, '$') or contains(x, '\\mathrm'))) > 0 as has_latex,
        case when own is null and hit is not null then hit.start else m.start end as start_offset, s.end_offset, s.continuations, s.table_rows, greatest(case when headed then len(g[1]) else 0 end, coalesce(list_max(list_transform(s.table_rows, lambda x: len(x))), 0)) as column_count
        from rowed m join (select paper_id, t, max(stop) as end_offset, count(*) - 1 as continuations, flatten(list(table_rows order by block)) as table_rows from rowed where t > 0 group by all) s on s.paper_id = m.paper_id and s.t = m.t where not m.continuation""",
    "figured": r"""select *, not regexp_matches(line, '^\s{0,3}#{1,6}\s') and regexp_matches(line, '^\s*(?:\[\^\d+\])?\s*(?:\*\*)?\s*(?:Figure|Fig|FIG)\s*\.?\s*([A-Z]?\d+|[IVXLC]+)\b\.?\s*(?:\*\*)?\s*(.*)$') as named, regexp_extract(line, '^\s*(?:\[\^\d+\])?\s*(?:\*\*)?\s*(?:Figure|Fig|FIG)\s*\.?\s*([A-Z]?\d+|[IVXLC]+)\b\.?\s*(?:\*\*)?\s*(.*)$', ['label', 'rest']) as c,
        regexp_extract(line, '^\s*!\[[^\]]*\]\(([^)]+)\)', 1) as url from piped""",
    "pictured": """select i.paper_id, i.url, i.start, i.stop, arg_min({label: x.c.label, rest: trim(x.c.rest), start: x.start, stop: x.stop}, case x.place - i.place when 1 then 1 when 2 then 2 when -1 then 3 else 4 end) as near from figured i join figured x on x.paper_id = i.paper_id and x.named and x.place - i.place in (1, 2, -1, -2) where i.url <> '' group by all""",
}

RECURSIVE = ("walk", "climb")


def needs(sql: str) -> list[str]:
    return [name for name in STEPS if re.search(rf"\b{name}\b", sql)]


def chain(sql: str) -> str:
    """The query with the steps that it needs in front, in their order."""
    wanted, todo = set(), needs(sql)
    while todo:
        name = todo.pop()
        if name not in wanted:
            wanted.add(name)
            todo += [n for n in needs(STEPS[name]) if n != name]
    steps = ",\n".join(f"{n} as {'' if n in RECURSIVE else 'materialized '}({STEPS[n]})" for n in STEPS if n in wanted)
    return f"with recursive {steps}\n{sql}" if steps else sql


def oracle(name: str, sql: str) -> None:
    ORACLE_SQL[name] = chain(sql)


JOINED = "array_to_string({0}, '|') as {0}"
oracle("methodology_class", "select *, case when methodology_class is null then 'unresolved' else 'resolved' end as status from methods")
oracle("methodology_terms", "select paper_id, (row_number() over (partition by paper_id order by hits desc, term) - 1)::int as rank, term, marker, hits from fired")
oracle("methodology_summary", "select coalesce(methodology_class, 'unresolved') as methodology_class, mixed_flag, count(*) as papers, sum(total_occurrences)::bigint as occurrences from methods group by 1, 2")
oracle("detect_headings", "select paper_id, level, byte_start, text_start, text_stop, span_start, inferred, text from headings")
oracle("infer_references", "select paper_id, level, byte_start, text from inferred")
oracle("heading_counts", "select c.paper_id, " + ", ".join(f"count(*) filter (level = {n}) as h{n}" for n in range(1, 7)) + " from cut c left join headings h using (paper_id) group by c.paper_id")
oracle("normalize_headings", "select heading_raw, heading_normalized from normal")
oracle("strip_identifier", "select heading_raw, stripped.stripped as stripped from stripped")
oracle("container_parse", "select heading_raw, container, label, remainder from boxed")
oracle("keyword_matches", "select p.paper_id, p.ordinal, s.keyword, s.role, s.b as match_start, s.e as match_end, s.suppressed_by from plain p join suppressed s on s.s = p.remainder where p.container is null")
oracle("nested_suppression", "select s.keyword, s.suppressed_by, count(*) as times from plain p join suppressed s on s.s = p.remainder where p.container is null and s.suppressed_by is not null group by all")
oracle("heading_roles", "select paper_id, ordinal, remainder as semantic_heading, role, content_class, case when method is null then 'unresolved' else 'resolved' end as status, method, array_to_string(candidates, '|') as candidate_roles, array_to_string(matched, '|') as matched_keywords from plain")
oracle("section_nodes", f"select * exclude (candidate_roles, matched_keywords), {JOINED.format('candidate_roles')}, {JOINED.format('matched_keywords')} from nodes")
oracle("parent_links", "select paper_id, ordinal, parent_ordinal from nodes")
oracle("section_spans", "select n.paper_id, ordinal, start_offset, end_offset, md5(decode(array_slice(encode(p.markdown), start_offset + 1, end_offset))) as text_md5 from nodes n join papers p using (paper_id)")
oracle("inherit_down", "select paper_id, ordinal, role, content_class from nodes where method = 'inherited'")
oracle("child_consensus", "select paper_id, ordinal, role, content_class from nodes where method = 'child_consensus'")
oracle("content_class_rollup", "select content_class, role, method, count(*) as sections, sum(end_offset - start_offset)::bigint as bytes from nodes group by all")
oracle("headless_papers", "select paper_id, heading_level, end_offset, role from nodes where heading_level = 0")
oracle("title_identification", "select paper_id, title_ordinal, title_status, title_method, title_text, candidate as title_candidate_ordinal from runs")
oracle("segmentation_runs", """select r.paper_id, r.run_id, '2.9' as rule_version, sha256(p.markdown) as markdown_hash, '2|3|4' as supported_levels, '5|6' as embedded_levels, """ + ", ".join(f"(select count(*) from headings h where h.paper_id = r.paper_id and level = {n}) as h{n}" for n in range(1, 7)) + """, (select count(*) from nodes n where n.paper_id = r.paper_id) as n_nodes,
    title_ordinal, title_status, title_method, title_text, case when title_ordinal >= 0 then 1 else 0 end as title_source_level, candidate as title_candidate_ordinal, 'Completed' as status from runs r join papers p using (paper_id)""")
oracle("published_runs", """select r.run_id, r.paper_id, sha256(p.markdown) as markdown_hash, case when r.paper_id % 3 = 0 then 2 else 1 end as version, count(n.paper_id) as nodes, count(n.role) as resolved from runs r join papers p using (paper_id)
    left join (select *, max(ordinal) over (partition by paper_id) as last from nodes) n on n.paper_id = r.paper_id and (r.paper_id % 3 <> 0 or n.ordinal < n.last) group by all""")
oracle("lost_nodes", """select paper_id, -1 as ordinal, 'node_count' as violation from cut where paper_id % 7 = 3 or paper_id % 5 in (1, 2)
    union all select paper_id, ordinal, case when start_offset + 3 > end_offset then 'inverted_span' end from nodes where paper_id % 5 = 3 and paper_id % 7 <> 3 and ordinal = 1 and start_offset + 3 > end_offset
    union all select n.paper_id, ordinal, 'inside_character' from nodes n join papers p using (paper_id) where n.paper_id % 5 = 3 and n.paper_id % 7 <> 3 and ordinal = 1 and start_offset + 3 < strlen(p.markdown)
        and regexp_matches(hex(array_slice(encode(p.markdown), start_offset + 4, start_offset + 4)), '^[89AB]')""")
oracle("invariant_violations", """select paper_id, ordinal, unnest(case when paper_id % 2 = 0 then ['inverted_span', 'parent'] else ['parent'] end) as violation from nodes where ordinal = 2""")
oracle("review_tasks", f"select run_id, task_ordinal, task_id, section_ordinal, review_reason, {JOINED.format('candidate_roles')}, {JOINED.format('matched_keywords')} from tasks")
oracle("decision_validation", "select decision_id, task_id, outcome from checked")
oracle("latest_decision", "select task_id, first_id as decision_id, decision, assigned_role, reviewer_id from inforce")
oracle("effective_roles", "select paper_id, ordinal, heading_raw, effective_role, effective_class, effective_status, from_review from noded")
oracle("effective_titles", "select run_id, title_text, title_node, title_status, title_method, from_review from title_views")
oracle("effective_view", """select t.run_id, n.ordinal, n.heading_raw, case when node_kind = 'document_title' then '(document title)' when effective_status = 'reviewer_rejected' then '— rejected' else coalesce(effective_role, '— still open') end as role,
    effective_class, effective_status, case when n.from_review then 'HUMAN' else coalesce(method, '—') end as source, t.title_text, t.title_status, g.state from noded n join title_views t using (paper_id) join gate_states g on g.run_id = t.run_id""")
oracle("gate_state", "select run_id, total, open, rejected, resolved, run_rejected, state from gate_states")
oracle("consumed_runs", "select run_id, frozen_at as consumed_at, asked_by as consumed_by from froze where wants = 'consume'")
oracle("freeze_check", "select decision_id, task_id, run_id, late as refused from intime where run_id is not null")
oracle("request_outcomes", """select request_id, run_id, wants as kind, open, rejected, run_rejected, state, case when request_id in (select request_id from froze) then case wants when 'consume' then 'consumed' else 'returned' end when wants = 'consume' and state = 'passed' then 'again' else 'refused' end as outcome
    from (select *, case when run_rejected or rejected > 0 then 'returned' when open > 0 then 'open' else 'passed' end as state from met_in_time)""")
oracle("run_superseded", "select r.run_id, x.ts as superseded_at from runs r left join refused x using (run_id)")
oracle("author_return", "select * from returns")
oracle("return_snapshot", "select * from reported")
oracle("review_run", """select t.run_id, t.task_id, t.review_reason, d.decision, c.heading_raw, coalesce(c.ancestors, '') as ancestors, md5(decode(array_slice(encode(p.markdown), c.start_offset + 1, c.end_offset))) as text_md5
    from tasks t join papers p using (paper_id) left join inforce d on d.task_id = t.task_id left join contexts c on c.paper_id = t.paper_id and c.ordinal = t.section_ordinal where t.paper_id % 7 <> 2""")
oracle("run_rejection_first", "select run_id, rejection_id, reviewer_id from refused")
oracle("review_context", "select * from contexts")
oracle("assignable_roles", f"""select role, coalesce(o.n, 0) as offered, coalesce(g.n, 0) as assigned from {values([(r,) for r in ROLE_NAMES], "role")} left join (select role, count(*) as n from (select unnest(candidate_roles) as role from tasks) group by 1) o using (role)
    left join (select assigned_role as role, count(*) as n from inforce where decision = 'resolve' group by 1) g using (role)""")
oracle("study_gate", "select * from gates")
oracle("study_evidence", """select kind, label, study_group, in_heading, count(*) as times from (select * from evidence where in_heading
    union all select * exclude (n) from (select e.*, row_number() over (partition by e.paper_id, study_group order by ordinal, i) as n from evidence e join several s using (paper_id) where not in_heading and kind in ('study', 'experiment') and len(s.strong) < 2) where n = 1) group by all""")
GATES = """select s.paper_id, s.paper_id * 2 as verdict_id, case when s.paper_id % 3 <> 0 then 'draft' when len(strong) >= 2 then 'multi' else 'other' end as verdict, len(strong) as study_count, e.position, e.kind, e.label from several s
    left join (select paper_id, kind, label, row_number() over (partition by paper_id order by not in_heading, ordinal, i) - 1 as position from (
        select paper_id, ordinal, i, kind, label, in_heading from evidence where in_heading
        union all select paper_id, ordinal, i, kind, label, in_heading from (select e.*, row_number() over (partition by e.paper_id, study_group order by ordinal, i) as n from evidence e join several s using (paper_id)
            where not in_heading and kind in ('study', 'experiment') and len(s.strong) < 2 and e.paper_id % 3 = 0) where n = 1)) e using (paper_id)"""
oracle("gate_upsert", GATES)
oracle("gate_store", f"select g.paper_id, sha256(p.markdown) as markdown_hash, verdict, study_count, position, kind, label from ({GATES}) g join papers p using (paper_id)")
oracle("research_unit_rows", "select paper_id, 'study' as unit_type, 1 as unit_index, 'RU1' as unit_ref, 'Study 1' as label, 'accepted_single_study' as status from gates where verdict = 'single'")
oracle("section_scope", "select n.paper_id, n.ordinal, n.role, coalesce(s.scope, 'undetermined') as scope, case when s.scope in ('study', 'both') then 'RU1' end as unit_ref from nodes n left join scopes s using (role)")
oracle("scope_summary", "select n.paper_id, coalesce(s.scope, 'undetermined') as scope, count(*) as sections from nodes n left join scopes s using (role) group by all")
oracle("verdict_contract", "select paper_id, outcome from verdicts")
QUOTES = "select paper_id, quotes_expected, quotes_verified, counter_verified, quotes_verified = quotes_expected and coalesce(counter_verified, true) as all_verified from quotes"
oracle("quote_verification", QUOTES)
oracle("bucketed_quotes", QUOTES)
oracle("paper_routing", """select paper_id, primary_type, empirical, case when quotes_verified <> quotes_expected then 'unverified_quotes' when not empirical then 'not_empirical' else 'allowed' end as route,
    concat_ws(': ', case primary_type when 'A' then 'empirical' when 'B' then 'synthesis of earlier studies' when 'C' then 'conceptual' when 'D' then 'formal' else 'unclassified' end, nullif(subtype, ''), case when primary_type = 'UNCLASSIFIED' then unclassified end) as reason from quotes""")
oracle("latest_verdict", "select p.paper_id, sha256(any_value(p.markdown)) as markdown_hash, max_by(verdict_id, (r.created_at, verdict_id)) as verdict_id, max(r.created_at) as created_at from responses r join papers p on p.paper_id = r.paper_id % 97 group by 1")
oracle("verdict_work_queue", "select paper_id, sha256(markdown || case when paper_id % 7 = 2 then 'x' else '' end) as markdown_hash from papers where paper_id % 7 = 2 or paper_id not in (select paper_id from verdicts where outcome = 'valid')")
oracle("model_input", """select p.paper_id, case when trim(p.markdown) <> '' and (p.paper_id % 2 = 0 or h.l is not null) then md5('INPUT FORM: ' || case when p.paper_id % 2 = 0 then 'FULL' else 'SELECTION' end || chr(10) || chr(10) ||
    coalesce('COMPLETE HEADING LIST (every heading in the document, in order):' || chr(10) || h.l || chr(10), '') || 'MANUSCRIPT:' || chr(10) || chr(10) || p.markdown) end as input_md5
    from papers p left join (select paper_id, string_agg('  ' || trim(text) || chr(10), '' order by byte_start) as l from headings group by 1) h using (paper_id)""")
oracle("pdf_dedupe", "select arg_min(paper_id, (created_at, paper_id)) as paper_id, hash, min(created_at) as created_at from landed group by hash")
oracle("markdown_hash", "select paper_id, sha256(markdown) as markdown_hash from papers")
oracle("paper_lifecycle", "select paper_id, status, title, case when status = 'ready' then sha256(markdown) end as markdown_hash from staged")
oracle("approved_source", "select paper_id, case when status <> 'ready' then 'not ready' when paper_id % 7 = 3 then 'hash differs' end as refusal, case when status = 'ready' and paper_id % 7 <> 3 then sha256(markdown) end as computed_hash from staged")
oracle("paper_list", "select paper_id, url, status, created_at from staged")
oracle("paper_upsert", "select user_id % 200 as paper_id, max_by(event_type, (ts, event_id)) as status, min_by(event_id, (ts, event_id)) as first_event, max_by(event_id, (ts, event_id)) as event_id from events group by 1")
oracle("insert_if_absent", "select user_id % 200 as paper_id, min_by(event_type, (ts, event_id)) as event_type, min_by(event_id, (ts, event_id)) as event_id from events group by 1")
oracle("latency_histogram", "select event_type, " + ", ".join(f"count(*) filter (value <= {b}) as le_{str(b).replace('.', '_')}" for b in LATENCY_BOUNDS) + ", round(sum(value), 4) as sum, count(value) as count from events group by 1")
LABEL = """event_type="' || event_type || '\""""


def metric_line(name: str, place: int, metric: str, more: str, value: str) -> str:
    return f"""select '{name}' as name, '{LABEL}' as key, {place} as place, '{metric}{{{LABEL}{more}}} ' || {value} as line from events group by event_type"""


EXACT_SUM = "case when sum(value::decimal(18, 2)) = floor(sum(value::decimal(18, 2))) then floor(sum(value::decimal(18, 2)))::bigint::varchar else sum(value::decimal(18, 2))::varchar end"
TIMED = [("bucket", f',le="{b:g}"', f"count(*) filter (value <= {b})") for b in LATENCY_BOUNDS]
TIMED += [("bucket", ',le="+Inf"', "count(value)"), ("sum", "", EXACT_SUM), ("count", "", "count(value)")]
oracle(
    "metrics_exposition",
    " union all ".join(
        [
            metric_line("events_total", 0, "events_total", "", "count(*)"),
            metric_line("last_user", 0, "last_user", "", "max_by(user_id, (ts, event_id))"),
            *(metric_line("event_seconds", i, f"event_seconds_{what}", more, value) for i, (what, more, value) in enumerate(TIMED)),
        ]
    ),
)
ENDED = """(select 'trees' as step, 'ok' as status, 2 as runs, 2 * count(*) as n from papers union all select 'nodes', 'ok', 2, 2 * count(*) from nodes
    union all select 'tasks', 'ok', 2, 2 * count(*) from tasks union all select 'broken', 'failed', 1, 0)"""
oracle("run_metrics", f"""select name, key, 0 as place, name || '{{' || key || '}} ' || n as line from
    (select 'step_rows_total' as name, 'step="' || step || '"' as key, n from {ENDED} union all select 'step_runs_total', 'step="' || step || '",status="' || status || '"', runs from {ENDED})""")
oracle("paper_lookup", "select 'id' as found_by, paper_id, hash from landed where paper_id = 7 union all select 'hash', paper_id, hash from landed where hash = md5('')")
oracle("content_hashes", "select doc_id, md5(coalesce(text, '')) as hash from documents")
oracle("whole_words", "select heading_raw, " + ", ".join(rf"regexp_matches(lower(heading_raw), '(^|[^\p{{L}}\p{{Nd}}_]){w}($|[^\p{{L}}\p{{Nd}}_])') as has_{w}" for w in ("study", "data", "results", "a")) + ", case when length(heading_raw) > 12 then left(heading_raw, 12) || '...' else heading_raw end as excerpt from texts")
oracle("identifier_vectors", r"""select doc_id, heading, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(heading, '^section\s+\d+[a-z]?\s*[:.\-]\s*', ''), '^\d+(\.\d+)*\s*[.:\-]?\s+', ''), '^[ivxlcdm]+\s*[.)]\s+', ''), '^[a-z]\s*[.)]\s+', ''),
    '^[:. ]+|[:. ]+$', '', 'g')) as stripped from (select doc_id, """ + DUCK.pick(IDENTIFIED, "doc_id") + """ || coalesce(' ' || lower(source), '') as heading from documents)""")
oracle("quote_folding", "select paper_id, md5(text) as folded_md5 from folded")
oracle("pipe_blocks", "select paper_id, first_place, n as rows_in_block, continuation from joined")
oracle("pipe_rows", "select paper_id, place, start, stop from piped where pipe")
oracle("table_captions", "select paper_id, kind, label, caption, caption_source, len(table_rows) as n_rows, column_count, has_latex, has_header, continuations, start_offset, end_offset from tables")
oracle("table_cells", "select coalesce(label, '') as label, array_to_string(row, '|') as cells, count(*) as times from (select label, unnest(table_rows) as row from tables) group by all")
oracle("figures", r"""select paper_id, near.label as label, near.rest as caption, url, least(start, near.start) as start_offset, greatest(stop, near.stop) as end_offset, coalesce(try_cast(regexp_extract(regexp_extract(url, '^[^?#]*'), '-(\d+)\.[A-Za-z]+$', 1) as int), 0) as page, """ + ", ".join(
    rf"coalesce(try_cast(regexp_extract(url, '[?&]{q}=(\d+)', 1) as int), 0) as {c}" for q, c in (("top_left_x", "crop_x"), ("top_left_y", "crop_y"), ("width", "crop_width"), ("height", "crop_height"))
) + " from pictured")
oracle("dropped_blocks", "select paper_id, count(*) as dropped_blocks from tabled where t = 0 group by 1")
oracle("section_asof", "select t.paper_id, t.label, t.start_offset, coalesce((select max_by(n.heading_raw, n.start_offset) from nodes n where n.paper_id = t.paper_id and n.start_offset <= t.start_offset), '—') as section from tables t")
oracle("offsets_asof", """select m.event_id, m.paper_id, m.position, max_by(n.ordinal, (n.start_offset, n.ordinal)) as ordinal, coalesce(max_by(n.heading_raw, (n.start_offset, n.ordinal)), '—') as section
    from mentions m left join nodes n on n.paper_id = m.paper_id and n.start_offset <= m.position group by m.event_id, m.paper_id, m.position""")
ARRIVALS = "select paper_id, hash, created_at, paper_id % 3 as batch from landed union all select -paper_id - 1, hash, -1, 2 from landed where paper_id % 3 = 0"
oracle("landed_batches", f"select paper_id, hash, first_value(paper_id) over (partition by hash order by batch, created_at, paper_id) as kept_id from ({ARRIVALS})")
oracle("migrated_papers", "select paper_id, case when paper_id % 2 = 1 then 'own ' || paper_id when paper_id % 29 = 7 then '' else sha256(markdown) end as markdown_hash from papers")
oracle("indexed_lookup", """select 'id' as found_by, paper_id, hash, url from landed where paper_id in (7, 11, 150)
    union all select 'hash', paper_id, hash, url from landed where hash = md5('') or hash in (select hash from landed where paper_id in (7, 11, 150))""")
