"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame; ORACLE_SQL has the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from maintspark.operators import effectivity as eff
from maintspark.functions import text
from maintspark.operators import assessment, catalogue, extract, findings, fleet, history, lookups, manuals, records, reliability, retrieval

from maintspark.sources import tables
from maintspark.streaming import streams

from .views import ata, duck, spread, view

AS_OF = "timestamp '2001-06-30 00:00:00'"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = duck(sql)


def _on(function, *views):
    """A query that applies a function to views."""
    return lambda spark, d: function(*(view(spark, d, v) for v in views))


def _as_of():
    return F.expr(AS_OF)


def _n(days: int) -> str:
    return f"count(*) filter (where occurrence_date >= {AS_OF} - interval {days} day)"


_COUNTS = f"select ata_code, {_n(30)} as n30, {_n(60)} as n60, {_n(90)} as n90 from occurrences group by ata_code"
_add("recurrence", _on(lambda o: reliability.recurrence(o, _as_of()), "occurrences"), _COUNTS)
_MTTR = f"select ata_code, avg(days_to_resolution) filter (where occurrence_date >= {AS_OF} - interval 90 day) as mttr_mean, max(days_to_resolution) filter (where occurrence_date >= {AS_OF} - interval 90 day) as mttr_max from occurrences group by ata_code"
_add("mttr", _on(lambda o: reliability.mttr(o, _as_of()), "occurrences"), _MTTR)
_RANKED = "select *, row_number() over (partition by ata_code order by coalesce(times_replaced,0) desc, part_number) as rk from parts"
_add("top_parts", _on(lambda p: reliability.top_parts(p).select("ata_code", "part_number", "times_replaced", "rank"), "parts"), f"select ata_code, part_number, times_replaced, rk as rank from ({_RANKED}) where rk <= 5")
_add(
    "ata_report",
    _on(lambda o, p: reliability.ata_report(o, p, _as_of()), "occurrences", "parts"),
    f"""select coalesce(c.ata_code, t.ata_code) as ata_code, coalesce(n30,0) as n30, coalesce(n60,0) as n60, coalesce(n90,0) as n90, mttr_mean, mttr_max,
    case when n90 > 0 then cast(floor(90*24/n90 + 0.5) as bigint) end as mtbf_low, case when n90 > 0 then cast(floor(120*24/n90 + 0.5) as bigint) end as mtbf_high,
    coalesce(n30,0)/30*100 as failure_rate, case when coalesce(n30,0) > (coalesce(n90,0)-coalesce(n30,0))/2 then 'increasing' else 'stable' end as trend, coalesce(top_parts, '') as top_parts
    from ({_COUNTS}) c full join (select ata_code, string_agg(part_number, ', ' order by rk) as top_parts from ({_RANKED}) where rk <= 5 group by ata_code) t on c.ata_code = t.ata_code left join ({_MTTR}) m on m.ata_code = c.ata_code""",
)
_add("rolling_recurrence", _on(lambda o: reliability.rolling_recurrence(o).select("id", "rolling"), "occurrences"), "select id, count(*) over (partition by ata_code order by occurrence_date range between interval 90 day preceding and current row) as rolling from occurrences")
_SUMS = "coalesce(sum(coalesce(downtime_minutes,0)),0) as total_minutes, count(*) filter (where status='open') as open_count, count(*) filter (where status is distinct from 'open') as resolved_count"
_add("downtime_rollup", _on(fleet.downtime_rollup, "downtime"), f"select aircraft_serial, ata_code, {_SUMS} from downtime group by rollup(aircraft_serial, ata_code)")
_add("downtime_by_aircraft", _on(fleet.by_aircraft, "downtime"), f"select aircraft_serial, {_SUMS} from downtime group by aircraft_serial")
_add(
    "downtime_by_aircraft_ata",
    _on(lambda x: fleet.by_aircraft_ata(x).select("aircraft_serial", F.array_join(F.transform("systems", lambda s: F.concat_ws(":", s["ata_code"], s["minutes"].cast("string"), s["n"].cast("string"))), ";").alias("systems")), "downtime"),
    "select aircraft_serial, string_agg(concat(ata_code, ':', cast(minutes as varchar), ':', cast(n as varchar)), ';' order by minutes desc, ata_code) as systems from (select aircraft_serial, ata_code, sum(coalesce(downtime_minutes,0)) as minutes, count(*) as n from downtime group by 1, 2) group by aircraft_serial",
)
_add(
    "downtime_labels",
    _on(lambda x: fleet.by_aircraft(x).select("aircraft_serial", fleet.format_duration(F.col("total_minutes")).alias("label")), "downtime"),
    "select aircraft_serial, case when m < 60 then concat(m, 'm') when m < 1440 then concat(m//60, 'h ', m%60, 'm') else concat(m//1440, 'd ', (m%1440)//60, 'h') end as label from (select aircraft_serial, cast(sum(coalesce(downtime_minutes,0)) as bigint) as m from downtime group by 1)",
)
_add("open_records", _on(lambda x: fleet.open_records(x).select("id", "user_id", "aircraft_serial"), "downtime"), "select id, user_id, aircraft_serial from downtime where status='open'")
_add("replacement_counts", _on(fleet.replacement_counts, "replacements"), "select part_on_pn, ata_code, count(*) as n from replacements group by 1, 2 order by n desc, 1, 2 limit 20")
_add("inventory_summary", _on(lambda p: fleet.inventory_summary(p, "24"), "parts"), "select count(*) as tracked, arg_max(part_number, (times_replaced, part_number)) as top_part, cast(sum(times_replaced) as bigint) as replaced from (select * from parts order by times_replaced desc, part_number limit 50) where ata_code='24'")
_add("high_failure", _on(lambda p: fleet.high_failure(p).select("ata_code", "part_number", "failure_rate", "rank"), "parts"), "select ata_code, part_number, failure_rate, rk as rank from (select *, row_number() over (partition by ata_code order by failure_rate desc, part_number) as rk from parts where failure_rate > 15) where rk <= 3")
_add("min_stock", _on(lambda p: fleet.min_stock(p).select("ata_code", "part_number", "quantity", "rank"), "parts"), f"select ata_code, part_number, cast(greatest(3, 2*ceil(times_replaced/4)) as bigint) as quantity, rk as rank from ({_RANKED}) where rk <= 5 and times_replaced > 2")
_add(
    "stock_alerts", _on(fleet.stock_alerts, "parts"),
    "select a.ata_code, critical, alert_parts from (select ata_code, bool_or(failure_rate > 20) as critical from parts group by 1) a left join (select ata_code, string_agg(part_number, ', ' order by rk) as alert_parts from (select *, row_number() over (partition by ata_code order by failure_rate desc, part_number) as rk from parts where failure_rate > 15) where rk <= 3 group by 1) b on a.ata_code=b.ata_code",
)
_add(
    "propagate_resolution",
    lambda spark, d: fleet.propagate_resolution(view(spark, d, "history").withColumn("diagnostic_query_id", F.col("id") * 2), view(spark, d, "downtime")).select("id", "solution_status"),
    "select id, case when id*2 in (select diagnostic_query_id from downtime where status='resolved') then 'resolved' else solution_status end as solution_status from history",
)
_add(
    "maintenance_alerts", _on(lambda p, logs: fleet.maintenance_alerts(p, logs).select("query_id", "n_logs", "newest"), "problems", "maintenance_logs"),
    "select query_id, coalesce(n, 0) as n_logs, coalesce(newest, '') as newest from problems p left join (select ata, count(*) as n, string_agg(cast(id as varchar), ',' order by rk) filter (where rk <= 3) as newest from (select *, row_number() over (partition by ata order by log_date desc, id desc) as rk from maintenance_logs) group by ata) l on l.ata = p.ata",
)
_RANGES = "(values " + ", ".join(f"({a}, {b}, '{c}')" for a, b, c in eff.SERIAL_RANGES) + ") r(serial_start, serial_end, configuration_code)"
_DIGITS = "try_cast(regexp_replace(serial_number, '[^0-9]', '', 'g') as int)"
_add(
    "resolve_configuration",
    lambda spark, d: eff.resolve_configuration(view(spark, d, "aircraft"), eff.serial_ranges(spark)),
    f"select aircraft_id, serial_number, serial, configuration, case when serial is null then 'invalid format' when configuration is null then 'not found' end as warning, configuration is not null as is_resolved from (select a.*, {_DIGITS} as serial, (select first(configuration_code order by serial_start, serial_end, configuration_code) from {_RANGES} where {_DIGITS} between serial_start and serial_end) as configuration from aircraft a)",
)
_SERIALS = f"(select distinct {_DIGITS} as serial from aircraft where {_DIGITS} >= 31005)"
_HITS = f"(select distinct serial, code from {_SERIALS} s join part_code_ranges on serial between serial_start and serial_end)"
_add("applicable_codes", _on(eff.applicable_codes, "aircraft", "part_code_ranges", "part_codes"), f"select serial, h.code, description, is_conditional from {_HITS} h join part_codes c on c.code=h.code where is_deleted=0")
_add(
    "applicable_summary", _on(eff.applicable_summary, "aircraft", "part_code_ranges", "part_codes"),
    f"select s.serial, count(c.code) as total, count(c.code) filter (where is_conditional=0) as standard, count(c.code) filter (where is_conditional=1) as conditional from {_SERIALS} s left join {_HITS} h on h.serial=s.serial left join (select * from part_codes where is_deleted=0) c on c.code=h.code group by s.serial",
)
_add(
    "classify_parts",
    lambda spark, d: eff.classify_parts(view(spark, d, "parts").selectExpr("lower(part_number) part_number", "'LN' configuration_code"), view(spark, d, "part_effectivity")),
    "select lower(p.part_number) as part_number, 'LN' as configuration_code, case when flag=1 then 'applicable' when flag=0 then 'not_applicable' else 'unknown' end as applicability from parts p left join (select part_number, max(is_applicable) as flag from part_effectivity where configuration_code='LN' group by 1) e on e.part_number=p.part_number",
)
_add("code_stats", _on(eff.code_stats, "part_codes", "part_code_ranges"), "select count(*) as total_codes, count(*) filter (where is_deleted=0) as active_codes, count(*) filter (where is_conditional=1) as conditional_codes, (select count(*) from part_code_ranges) as total_ranges from part_codes")
_add("search_codes", _on(lambda c: eff.search_codes(c, "e001"), "part_codes"), "select * from part_codes where contains(upper(code), 'E001') or contains(upper(description), 'E001')")
_CLEAN = r"regexp_replace(lower(coalesce(problem,'')), '[^a-z0-9 \t\n\x0B\f\r]', ' ', 'g')"
_WORDS = f"list_filter(string_split_regex({_CLEAN}, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: length(w) > 3)[1:8]"
_add("keywords", _on(lambda p: p.select("query_id", F.array_join(history.keywords(F.col("problem"), stop_words=()), " ").alias("words")), "problems"), f"select query_id, array_to_string({_WORDS}, ' ') as words from problems")
_add("issue_signature", _on(lambda h: h.select("id", history.issue_signature(F.col("ata"), F.col("problem")).alias("signature")), "history"), "select id, concat(ata, ':', substr(regexp_replace(lower(problem), '[^a-z0-9]', '', 'g'), 1, 50)) as signature from history")
_add("status_counts", _on(history.status_counts, "history"), "select count(*) as total, count(*) filter (where solution_status='resolved') as resolved, count(*) filter (where solution_status is distinct from 'resolved') as pending from history")
_add("recent", _on(lambda x: history.recent(x, "user_id", "diagnosis_started_at", 3).select("user_id", "id", "rank"), "downtime"), "select user_id, id, rk as rank from (select *, row_number() over (partition by user_id order by diagnosis_started_at desc, id) as rk from downtime) where rk <= 3")
_add("facet_filter", _on(lambda h: history.facet_filter(h, "The", "24", "pending").select("id"), "history"), "select id from history where contains(lower(problem), 'the') and ata='24' and solution_status is distinct from 'resolved'")
_add(
    "similar_cases", _on(lambda p, h: history.similar_cases(p, spread(h), stop_words=()), "problems", "history"),
    f"""select query_id, id, score, rk as rank from (select query_id, id, score, row_number() over (partition by query_id order by score desc, resolved_seq desc, id) as rk from (
    select query_id, id, resolved_seq, hits, hits + case when serial_number=aircraft_serial then 1 else 0 end as score from (select q.query_id, h.id, h.resolved_seq, serial_number, aircraft_serial, len(list_filter(words, lambda w: contains(clean, w))) as hits
    from (select query_id, ata, serial_number, {_WORDS} as words from problems) q join (select id, ata, aircraft_serial, resolved_seq, {_CLEAN} as clean from history where solution_status='resolved') h on q.ata is null or q.ata=h.ata) where hits >= 2)) where rk <= 3""",
)
# the same with the reference's stop words
_TELLING = _WORDS.replace("length(w) > 3", f"length(w) > 3 and w not in {history.STOP_WORDS}")
_add("telling_keywords", _on(lambda p: p.select("query_id", F.array_join(history.keywords(F.col("problem")), " ").alias("words")), "problems"), f"select query_id, array_to_string({_TELLING}, ' ') as words from problems")
_add(
    "telling_cases", _on(lambda p, h: history.similar_cases(p, spread(h)), "problems", "history"),
    f"""select query_id, id, score, rk as rank from (select query_id, id, score, row_number() over (partition by query_id order by score desc, resolved_seq desc, id) as rk from (
    select query_id, id, resolved_seq, hits, hits + case when serial_number=aircraft_serial then 1 else 0 end as score from (select q.query_id, h.id, h.resolved_seq, serial_number, aircraft_serial, len(list_filter(words, lambda w: contains(clean, w))) as hits
    from (select query_id, ata, serial_number, {_TELLING} as words from problems) q join (select id, ata, aircraft_serial, resolved_seq, {_CLEAN} as clean from history where solution_status='resolved') h on q.ata is null or q.ata=h.ata) where hits >= 2)) where rk <= 3""",
)
_add("index_stats", _on(retrieval.index_stats, "corpus"), "select count(*) as documents, count(*) filter (where len(embedding) > 0) as with_embedding, count(*) filter (where length(doc_path) > 0) as with_path from corpus")
_add("document_ids", _on(lambda c: c.select("doc_id", retrieval.document_id(F.col("doc_path")).alias("document_id")), "corpus"), "select doc_id, replace(replace(replace(string_split(doc_path, '/')[-1], 'dmc-', ''), '.xml', ''), '.pdf', '') as document_id from corpus")
_COS = "round(list_cosine_similarity(cast(q.embedding as double[]), cast(c.embedding as double[])), 6)"
_add(
    "retrieval_search",
    lambda spark, d: retrieval.search(c := view(spark, d, "corpus"), c.where("doc_id % 50 = 0").selectExpr("doc_id query_id", "embedding")).select("query_id", "rank", "score"),
    f"select query_id, rk as rank, score from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rk from (select q.doc_id as query_id, c.doc_id, {_COS} as score from corpus q cross join corpus c where q.doc_id % 50 = 0) where score > 0) where rk <= 5",
)
_add(
    "coverage",
    lambda spark, d: extract.coverage(view(spark, d, "corpus").selectExpr("doc_id % 40 query_id", "doc_path"), F.contains("doc_path", F.lit("-24-"))),
    "select query_id, count(*) as docs, count(*) filter (where contains(doc_path, '-24-')) as matched, 0 as high, case when count(*) filter (where contains(doc_path, '-24-'))/count(*) >= 0.8 then 85 when count(*) filter (where contains(doc_path, '-24-'))/count(*) >= 0.5 then 65 when count(*) filter (where contains(doc_path, '-24-'))/count(*) >= 0.2 then 40 else 15 end as coverage from (select doc_id % 40 as query_id, doc_path from corpus) group by 1",
)
_add(
    "escalation_gate",
    _on(lambda x: x.select("id", extract.evidence_score(F.col("downtime_minutes") % 12).alias("evidence")), "downtime"),
    "select id, case when m <= 0 then 0 when m <= 2 then 20 when m <= 4 then 40 when m <= 6 then 60 when m <= 9 then 80 else 100 end as evidence from (select id, downtime_minutes % 12 as m from downtime)",
)
_add("all_pages", _on(lambda h: records.pages(h.select("id", "ata")), "history"), "select id, ata, cast((row_number() over (order by id) - 1) // 20 + 1 as bigint) as page from history")
_add("page", _on(lambda h: records.page(h.select("id", "ata"), 3), "history"), "select id, ata from history order by id limit 20 offset 40")
_add("latest", _on(lambda x: records.latest(x.select("id", "aircraft_serial", "diagnosis_started_at"), "diagnosis_started_at").select("id", "aircraft_serial"), "downtime"), "select id, aircraft_serial from downtime order by diagnosis_started_at desc, id limit 50")
_add(
    "selftest_summary",
    _on(lambda x: records.selftest_summary(x.selectExpr("tsn / 10.0D relevance", "tsn % 9 chunks", "id % 2 = 0 has_references")), "maintenance_logs"),
    "select count(*) as tests_run, avg(tsn / 10.0) as avg_relevance, avg(tsn % 9) as avg_chunks, case when bool_or(tsn % 9 = 0) then 'FAIL' else 'PASS' end as rag, case when bool_or(id % 2 = 0) then 'PASS' else 'FAIL' end as crew from maintenance_logs",
)
_add(
    "upsert_from_all_replacements", _on(fleet.upsert_from_replacements, "parts", "replacements"),
    "select coalesce(p.part_number, r.part_on_pn) as part_number, coalesce(description, concat('Part ', r.part_on_pn)) as description, coalesce(p.ata_code, r.ata_code) as ata_code, coalesce(times_replaced,0)+coalesce(n,0) as times_replaced, coalesce(failure_rate,0) as failure_rate from parts p full join (select part_on_pn, min(ata_code) as ata_code, count(*) as n from replacements group by 1) r on r.part_on_pn=p.part_number",
)
_add("codes_without_any_range", _on(lambda c, r: records.codes_without_ranges(c, r).select("code"), "part_codes", "part_code_ranges"), "select code from part_codes where code not in (select code from part_code_ranges)")
_add(
    "apply_all_solutions",
    _on(lambda h, p: records.apply_solutions(h, p.selectExpr("query_id history_id", "problem solution", "query_id submitted_at")).select("id", "solution_status", "solution"), "history", "problems"),
    "select id, case when s.problem is not null then 'resolved' else solution_status end as solution_status, s.problem as solution from history left join problems s on s.query_id = id",
)
_add(
    "certainty_gates", _on(lambda m: m.select("id", text.gate(F.col("tsn") % 101).alias("gate"), extract.connector_gate(F.col("tsn") % 101 / 100, F.col("type"))["expert_required"].alias("expert_required")), "maintenance_logs"),
    "select id, case when tsn % 101 >= 95 then 'SAFE_TO_PROCEED' else 'REQUIRE_EXPERT' end as gate, (tsn % 101) / 100 < 0.95 as expert_required from maintenance_logs",
)
_add(
    "history_with_parts", _on(lambda h, r: history.with_replacements(h, r).select("id", F.size("replaced_parts").alias("n_parts"), F.coalesce(F.array_join(F.transform("replaced_parts", lambda p: p["part_on_pn"]), ","), F.lit("")).alias("parts")), "history", "replacements"),
    "select h.id, coalesce(n, 0) as n_parts, coalesce(p, '') as parts from history h left join (select troubleshooting_id, count(*) as n, string_agg(part_on_pn, ',' order by id, part_off_pn, part_on_pn) as p from replacements group by 1) r on r.troubleshooting_id = h.id",
)
_add(
    "wiring_documents", _on(lambda c: c.select("doc_id", text.is_wiring_doc(F.col("doc_path"), F.col("text")).alias("wiring"), text.truncated(F.col("text"), F.col("doc_path"), 40).alias("start")), "corpus"),
    "select doc_id, contains(lower(doc_path), '39-a-awdp') or contains(lower(substr(text, 1, 1000)), '39-a-awdp') or contains(lower(substr(text, 1, 1000)), 'wiring diagram') as wiring, case when length(coalesce(text, '')) < 20 then '[FALLBACK] ' || doc_path else substr(text, 1, 40) end as start from corpus",
)
_add("whole_maintenance_log", _on(lambda x: x.select("id", "ata", "tsn"), "maintenance_logs"), "select id, ata, tsn from maintenance_logs")


def _merge_all(problems, corpus):
    """Each system's own documents, then the rest of the corpus."""
    systems = problems.where("ata is not null").selectExpr("ata query_id").distinct()
    every = systems.crossJoin(corpus.select("doc_path", "doc_id"))
    own = every.where(F.contains("doc_path", F.concat(F.lit("-A-"), "query_id", F.lit("-"))))
    return records.merge_unique(own, every)


_EVERY = "(select query_id, doc_path, doc_id, contains(doc_path, concat('-A-', query_id, '-')) as own from (select distinct ata as query_id from problems where ata is not null) cross join corpus)"
_add(
    "merge_all_unique", _on(_merge_all, "problems", "corpus"),
    f"select query_id, doc_path, doc_id from {_EVERY} where own union all select query_id, doc_path, doc_id from {_EVERY} e where not own and not exists (select 1 from {_EVERY} o where o.own and o.query_id = e.query_id and o.doc_path = e.doc_path)",
)


def _sql_has(column: str, words) -> str:
    return "(" + " or ".join(f"contains({column}, '{w}')" for w in words) + ")"


_NAMES = "(values " + ", ".join(f"('{k}', '{v}')" for k, v in lookups.ATA_NAMES.items()) + ") n(k, v)"
_add("occurrences_by_ata", _on(lambda o: lookups.occurrences_by_ata(o).select("id", "ata_code", "aircraft_serial"), "occurrences"), "select id, ata_code, aircraft_serial from occurrences")
_add("parts_by_ata", _on(lambda p: lookups.parts_by_ata(p, "24").select("part_number", "times_replaced"), "parts"), "select part_number, times_replaced from parts where ata_code = '24'")
_add("ata_names", _on(lambda p: lookups.ata_name(p).select("part_number", "ata_name"), "parts"), f"select part_number, coalesce(n.v, 'ATA ' || ata_code || ' System') as ata_name from parts left join {_NAMES} on n.k = ata_code")
_add(
    "related_maintenance", _on(lambda q, m: lookups.related_maintenance(q, m).groupBy("query_id").agg(F.count("*").alias("n"), F.max("tsn").alias("most_hours")), "problems", "maintenance_logs"),
    "select query_id, count(*) as n, max(tsn) as most_hours from problems p join maintenance_logs m on m.ata = p.ata group by query_id",
)
_add(
    "query_types", _on(lambda p: p.select("query_id", manuals.query_type(F.col("problem")).alias("query_type")), "problems"),
    f"""select query_id, case when {_sql_has("lower(problem)", manuals.FAULT)} then 'fault_code'
    when {_sql_has("lower(problem)", manuals.CALIBRATION)} or ({_sql_has("lower(problem)", manuals.READING)} and {_sql_has("lower(problem)", manuals.READ_UNITS)}) then 'calibration'
    when {_sql_has("lower(problem)", manuals.PROCEDURE)} then 'procedure' when {_sql_has("lower(problem)", manuals.ELECTRICAL)} then 'electrical' else 'general' end as query_type from problems""",
)
_add("enhanced_queries", _on(lambda p: p.select("query_id", manuals.enhance_query(F.col("problem"), F.col("ata")).alias("query")), "problems"), "select query_id, case when ata is null then problem else 'ATA ' || ata || ': ' || problem end as query from problems")
_add(
    "ata_filtered", _on(lambda c, p: manuals.filter_counts(c, p.withColumnRenamed("ata", "filter")), "corpus", "problems"),
    "with h as (select query_id, doc_id from problems join corpus on contains(doc_path, '-' || ata || '-')) select query_id, count(*) as n, sum(doc_id) as ids from (select * from h union all select query_id, doc_id from problems cross join corpus where query_id not in (select query_id from h)) group by query_id",
)
_add(
    "training_filtered", _on(lambda c, p: manuals.filter_counts(c, p.select("query_id", F.lit("PT6C_67CD").alias("filter"))), "corpus", "problems"),
    f"""with h as (select query_id, doc_id from problems join corpus on {_sql_has("lower(text)", manuals.MATERIALS["PT6C_67CD"][1])} or {_sql_has("lower(doc_path)", manuals.MATERIALS["PT6C_67CD"][1])}),
    ten as (select doc_id from corpus order by doc_path, doc_id limit 10)
    select query_id, count(*) as n, sum(doc_id) as ids from (select * from h union all select query_id, doc_id from problems cross join ten where query_id not in (select query_id from h)) group by query_id""",
)
_MATERIALS = "(" + " union all ".join(f"select '{key}' as filter, doc_id from manuals where {_sql_has('lower(text)', words)} or {_sql_has('lower(doc_path)', words)}" for key, (_, words) in manuals.MATERIALS.items()) + ")"
#: The documents that each question's filter leaves, pair by pair.
_CANDIDATES = f"""asked as (select *, coalesce(filter, '') in ('PRIMUS_EPIC', 'PT6C_67CD', 'AW139_AIRFRAME') as material, regexp_matches(coalesce(filter, ''), '^[0-9]+$') as numbered from questions),
    m as {_MATERIALS}, ten as (select doc_id from manuals order by doc_path, doc_id limit 10), hit as (select query_id, doc_id from asked join manuals on numbered and contains(doc_path, '-' || filter || '-')),
    candidates as (select query_id, doc_id from asked join m on m.filter = asked.filter union all select query_id, doc_id from asked cross join ten where material and filter not in (select filter from m)
    union all select * from hit union all select query_id, doc_id from asked cross join manuals where numbered and query_id not in (select query_id from hit) union all select query_id, doc_id from asked cross join manuals where not material and not numbered)"""
_add(
    "filtered_documents", _on(manuals.filter_counts, "manuals", "questions"),
    f"with {_CANDIDATES} select query_id, count(*) as n, sum(doc_id)::bigint as ids from candidates group by query_id",
)
_STARTING = _sql_has("q", ("start", "wont start"))
_AWDP = _sql_has("d", ("awdp", "wiring diagram", "wiring data"))
_BOOST = f"""(case when contains(q, 'does not start') and contains(d, 'does not start') then 0.15e0 else 0e0 end + case when contains(q, 'not starting') and contains(d, 'not starting') then 0.15e0 else 0e0 end
    + case when contains(q, 'will not start') and {_sql_has('d', ('will not start', 'does not start'))} then 0.15e0 else 0e0 end + case when {_STARTING} and {_sql_has('d', ('start sequence', 'start cycle', 'starting system'))} then 0.12e0 else 0e0 end
    + case when contains(q, 'start') and contains(d, 'starter generator') then 0.1e0 else 0e0 end + case when {_STARTING} and contains(d, 'engine start') then 0.08e0 else 0e0 end
    - case when {_STARTING} and {_sql_has('d', ('gen hot', 'overheat', 'temperature'))} and not {_sql_has('q', ('hot', 'overheat', 'temperature'))} then 0.12e0 else 0e0 end
    + case when contains(d, 'fault isolation') and contains(q, 'start') and {_sql_has('d', ('start', 'crank'))} then 0.1e0 else 0e0 end + case when contains(d, 'fault isolation') and contains(q, 'hot') and contains(d, 'hot') then 0.1e0 else 0e0 end
    + case when {_AWDP} and {_sql_has('q', ('electrical', 'wiring', 'wire', 'connector', 'pin', 'circuit'))} then 0.12e0 else 0e0 end + case when {_AWDP} and {_sql_has('q', ('generator', 'starter'))} then 0.08e0 else 0e0 end
    + case when {_AWDP} and {_sql_has('q', ('fault', 'does not', 'not working'))} then 0.06e0 else 0e0 end)"""
_add(
    "keyword_boosts", _on(lambda c, q: manuals.boost_totals(c, q).select("query_id", "total"), "manuals", "questions"),
    f"select query_id, sum(cast(round({_BOOST} * 100) as bigint)) / 100 as total from (select query_id, lower(query) as q from questions) cross join (select lower(text) as d from manuals) group by query_id",
)
_add(
    "manual_search", _on(lambda c, q: manuals.search(c, q).drop("content", "snippet", "reference"), "manuals", "questions"),
    f"""with {_CANDIDATES}, pairs as (select query_id, doc_id, doc_path, lower(query) as q, lower(text) as d, list_cosine_similarity(cast(asked.embedding as double[]), cast(manuals.embedding as double[])) as cos,
    contains(lower(doc_path), '39-a-awdp') or contains(lower(substr(text, 1, 1000)), '39-a-awdp') or contains(lower(substr(text, 1, 1000)), 'wiring diagram') as wiring from candidates join asked using (query_id) join manuals using (doc_id)),
    scored as (select query_id, doc_id, doc_path, wiring, {_sql_has('q', ('generator', 'starter', 'electrical', 'wiring', 'connector'))} as asks, round(cos + {_BOOST}, 12) as score from pairs),
    top as (select * from (select *, row_number() over (partition by query_id order by score desc, doc_path, doc_id) as rank from scored where score > 0) where rank <= 5),
    best as (select *, row_number() over (partition by query_id order by score desc, doc_path, doc_id) as rn from scored where wiring and asks and query_id not in (select query_id from top where wiring)),
    shown as (select query_id, rank, doc_id, doc_path, score from top union all select query_id, coalesce((select max(rank) from top where top.query_id = best.query_id), 0) + 1, doc_id, doc_path, score from best where rn = 1)
    select query_id, rank, doc_id, doc_path, round(score, 4) as similarity_score, replace(replace(replace(string_split(doc_path, '/')[-1], 'dmc-', ''), '.xml', ''), '.pdf', '') as document_id from shown""",
)
#: DuckDB's expressions know no word characters beyond ASCII, so letters beyond it count as _ there, which is one and in no pattern.
_PLAIN = "regexp_replace(coalesce(diagnosis, ''), '[À-ÖØ-öø-ÿŒœſ]', '_', 'g')"


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _matches(column: str, pattern: str, options: str = "") -> str:
    return f"regexp_matches({column}, {_sql_text(pattern.replace('(?i)', ''))}, '{options}i')" if "i" in options or "(?i)" in pattern else f"regexp_matches({column}, {_sql_text(pattern)})"


def _found(column: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({column}, {_sql_text(pattern.replace('(?i)', ''))}, {group}, 'i')"


_REFERENCES = "list_transform(" + "list_concat(" * (len(findings.REFERENCES) - 1) + _found("diagnosis", findings.REFERENCES[0], 1) + "".join(f", {_found('diagnosis', p, 1)})" for p in findings.REFERENCES[1:]) + ", lambda x: replace(upper(x), ' ', '-'))"
_REFERENCES = f"list_filter({_REFERENCES}, lambda x, i: list_position({_REFERENCES}, x) = i)[1:15]"
_STATUS = r"case when regexp_matches(diagnosis, '(?m)^\s*\d+\.') then case when regexp_matches(diagnosis, '\d{2}-[A-Z]-\d{2}-\d{2}', 'i') then 'VERIFIED - NO CORRECTIONS' else 'VERIFIED WITH IMPROVEMENTS' end else 'CRITICAL CORRECTION REQUIRED' end"
_add(
    "manual_references", _on(lambda d: d.select("query_id", F.array_join(findings.references(F.col("diagnosis")), ",").alias("refs"), findings.verification(F.col("diagnosis")).alias("status")), "diagnoses"),
    f"select query_id, coalesce(array_to_string({_REFERENCES}, ','), '') as refs, {_STATUS} as status from (select query_id, coalesce(diagnosis, '') as diagnosis from diagnoses)",
)
_add(
    "simple_scores", _on(lambda d: d.select("query_id", findings.simple_score(F.size(findings.references(F.col("diagnosis"))), F.col("ata").isNotNull(), F.col("diagnosis")).alias("score")), "diagnoses"),
    f"select query_id, least(100, 50 + least(30, 8 * len({_REFERENCES})) + 10 + case when length(diagnosis)>500 then 5 else 0 end + case when length(diagnosis)>1000 then 5 else 0 end + case when {_sql_has('lower(diagnosis)', ('amm', 'ietp', 'amp'))} then 5 else 0 end + case when {_sql_has('lower(diagnosis)', ('procedure', 'step'))} then 3 else 0 end) as score from (select query_id, coalesce(diagnosis, '') as diagnosis from diagnoses)",
)


def _certainty_report(diagnoses, documents, retrieved):
    """Each diagnosis with all documents of its pool, and the few that a search scored."""
    docs = documents.select(F.expr(ata("doc_id")).alias("pool"), "doc_path", F.col("text").alias("content"))
    covered = assessment.pooled_coverage(diagnoses, docs, retrieved)
    return assessment.assessed(spread(diagnoses), covered).drop("missing_subsystems", "evidence_count")


_TAG = "case when chosen in ('PRIMUS_EPIC', 'PT6C_67CD', 'AW139_AIRFRAME') then chosen else substr(trim(replace(coalesce(chosen, ''), 'ATA ', '')), 1, 2) end"
_FITS = "(tag = '' or case tag " + " ".join(f"when '{name}' then {_sql_has('p', words)} or {_sql_has('c', words)}" for name, words in assessment.COVERED.items()) + " else contains(p, '-' || tag || '-') end)"
_COVERAGE = f"""q as (select query_id, pool, {_TAG} as tag from diagnoses), dd as (select {ata('doc_id')} as pool, lower(doc_path) as p, lower(text) as c from manuals), rr as (select query_id, score, lower(doc_path) as p, lower(content) as c from retrieved),
    pools as (select distinct pool, tag from q), pc as (select pools.pool, tag, count(*) as docs, count(*) filter (where {_FITS}) as matched from pools join dd using (pool) group by pools.pool, tag),
    hh as (select query_id, count(*) as high from q join rr using (query_id) where score > 0.7 and {_FITS} group by query_id),
    covered as (select query_id, coalesce(docs, 0) as docs, coalesce(matched, 0) as matched, coalesce(high, 0) as high, case when coalesce(docs, 0) = 0 then 0 when matched / docs >= 0.8 and high >= 3 then 100 when matched / docs >= 0.8 then 85 when matched / docs >= 0.5 then 65 when matched / docs >= 0.2 then 40 else 15 end as coverage from q left join pc using (pool, tag) left join hh using (query_id))"""
_add(
    "pooled_coverage", _on(lambda d, m, r: assessment.pooled_coverage(d, m.select(F.expr(ata("doc_id")).alias("pool"), "doc_path", F.col("text").alias("content")), r), "diagnoses", "manuals", "retrieved"),
    f"with {_COVERAGE} select query_id, docs, matched, high, coverage from covered",
)
_LOW = ", ".join(f"{_matches('low', p)} as f_{k}" for k, p in assessment.LOW_FLAGS.items())
_ANY = ", ".join(f"{_matches('t', p, 'i')} as f_{k}" for k, p in assessment.FLAGS.items())
_EVIDENCE = " + ".join(f"len(regexp_extract_all(t, {_sql_text(p.removeprefix('(?iU)'))}, 0, 'i'))" for p in extract.UNITS.values())
_NEEDED = " + ".join(f"case when {_sql_has('q', asks)} and not {_sql_has('dl', needs)} then 1 else 0 end" for asks, needs in assessment.SUBSYSTEMS.values())
_CAUSE_ROWS = [(_found("dg", r"(\d{1,3})\s*%[:\s]*([^.\n]+)", 1), _found("dg", r"(\d{1,3})\s*%[:\s]*([^.\n]+)", 2)), (_found("dg", r"([^.\n]+)\s*\((\d{1,3})\s*%\)", 2), _found("dg", r"([^.\n]+)\s*\((\d{1,3})\s*%\)", 1))]
_CAUSES = " or ".join([f"len(list_filter(range(1, len({a}) + 1), lambda i: cast(({a})[i] as int) between 5 and 100 and length(trim(({b})[i])) > 10)) > 0" for a, b in _CAUSE_ROWS] + [_sql_has("dl", [w for w, *_ in findings.CAUSES])])
_STOP = "(" + ", ".join(f"'{w}'" for w in assessment.STOP_WORDS) + ")"
_add(
    "certainty_report", _on(_certainty_report, "diagnoses", "manuals", "retrieved"),
    f"""with {_COVERAGE},
    a as (select query_id, coalesce(task_type, '') as task, coalesce(has_wiring, false) as wired, coalesce(diagnosis, '') as dg, lower(coalesce(diagnosis, '')) as dl, {_PLAIN} as t, lower({_PLAIN}) as low, lower(coalesce(query, '')) as q from diagnoses),
    b as (select *, {_LOW}, {_ANY}, len(regexp_extract_all(t, '\\b\\d{{1,3}}\\s*%')) >= 2 as two, {_NEEDED} as missing, {_sql_has('dl', assessment.ELECTRICAL)} and {_sql_has('q', assessment.MECHANICAL)} as mismatch,
        list_filter(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(q, '\\[.*?\\]', '', 'g'), 'ata\\s*\\d+', '', 'g'), 'aw139|s/n:?\\s*\\d+', '', 'g'), '\\b[a-z]{{4,}}\\b')), lambda w: w not in {_STOP}) as words from a),
    c as (select *, f_likelihood or f_suspect or two as ranking, f_generic_check and not f_component and not f_mechanism as generic, task in {assessment.FAULT_TASKS} as is_fault, task in {assessment.PROCEDURE_TASKS} as is_proc, f_dmc or f_full_dmc as coded,
        ((f_likelihood or f_suspect or two) and f_signal_path) or (f_operation and (f_likelihood or f_suspect or two)) or (f_signal_path and f_mechanism) as deep,
        {_EVIDENCE} + case when f_dmc then 3 else 0 end + case when f_full_dmc then 2 else 0 end + case when f_amp then 2 else 0 end + case when f_awdp_ref then 2 else 0 end + case when f_part_number then 2 else 0 end + case when f_connector_pin then 1 else 0 end as n,
        case when len(words) = 0 then null else len(list_filter(words, lambda w: contains(dl, w))) / len(words) end as share from b),
    d as (select *, case when is_proc then least(20 * f_component::int + 25 * f_steps::int + 15 * f_tool::int + 15 * f_safety::int + 10 * f_order::int + 15 * coded::int, case when f_steps or coded then 100 else 30 end)
        else least(20 * f_component::int + 20 * f_causal::int + 15 * f_mechanism::int + 10 * f_location::int + 10 * f_failure_mode::int + 10 * ranking::int + 10 * f_signal_path::int + 10 * f_operation::int, case when f_component or f_mechanism or deep then 100 else 30 end, case when f_causal or deep then 100 else 50 end) end as system,
        case when n <= 0 then 0 when n <= 2 then 20 when n <= 4 then 40 when n <= 6 then 60 when n <= 9 then 80 else 100 end as evidence,
        least(case when share is null then 50 when share >= 0.6 then 100 when share >= 0.4 then 70 when share >= 0.2 then 45 else 20 end, case when missing > 0 then 25 else 100 end, case when generic then 35 else 100 end, case when mismatch and not f_mechanism then 40 else 100 end) as alignment,
        case when is_fault then case when wired and f_awdp_ref then 100 when wired then 70 when f_awdp_ref then 60 else 20 end when is_proc then case when f_amp or f_dmc then 100 else 40 end when f_amp or f_dmc or f_awdp_ref then 100 else 50 end as diagram from c),
    e as (select *, least(coverage * 0.25e0 + system * 0.25e0 + evidence * 0.2e0 + alignment * 0.2e0 + diagram * 0.1e0,
        case when is_proc and not (f_amp or f_dmc or f_awdp_ref or f_full_dmc) then 88 else 100 end, case when is_proc and not f_steps and not f_component then 82 else 100 end,
        case when not is_proc and is_fault and not (wired or f_awdp_ref) and not deep then 85 else 100 end, case when not is_proc and generic and not deep then 80 else 100 end, case when not is_proc and not (f_amp or f_dmc or f_awdp_ref) and not deep then 85 else 100 end,
        case when not is_proc and not f_component and not f_part_number then 82 else 100 end, case when not is_proc and is_fault and not f_causal and not deep then 80 else 100 end, case when not is_proc and missing > 0 and not deep then 75 else 100 end, case when not is_proc and mismatch and not f_mechanism then 78 else 100 end) as capped,
        case when is_proc then coverage >= 80 and system >= 60 and (f_amp or f_dmc or f_full_dmc) and (f_steps or f_component) and alignment >= 50
        else (system >= 75 and coverage >= 85 and n >= 5 and alignment >= 70 and f_component and f_causal and missing = 0 and (not is_fault or wired or f_awdp_ref) and (f_amp or f_dmc or f_awdp_ref)) or (system >= 70 and coverage >= 65 and n >= 3 and alignment >= 60 and f_component and deep and ranking) end as passes from d join covered using (query_id)),
    f as (select *, greatest(40, least(100, cast(round_even(case when capped >= 95 and not passes then 94 else capped end, 0) as int))) as score from e),
    g as (select *, least(score, case when task = 'fault_isolation' and not ({_CAUSES}) then 80 else 100 end, case when task in ('remove_procedure', 'install_procedure') and not regexp_matches(dg, '(?m)^\\s*\\d+\\.') then 75 else 100 end) as certainty from f)
    select query_id, task as task_type, coverage, system, evidence, alignment, diagram, certainty, case when certainty >= 95 then 'SAFE_TO_PROCEED' else 'REQUIRE_EXPERT' end as certainty_status from g""",
)


def _diagnosis_report(diagnoses, retrieved):
    """With what was retrieved for each diagnosis: its references stand in where the text has none, and its texts may have wiring."""
    each = retrieved.where("score > 0.3").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("k", "doc_path", "content"))).alias("docs"))
    path = lambda d: F.regexp_replace(F.upper(F.element_at(F.split(d["doc_path"], "/"), -1)), r"\.XML$", "")
    known = spread(diagnoses).join(each.select("query_id", F.transform("docs", path).alias("retrieved_refs"), F.transform("docs", lambda d: F.concat(d["doc_path"], F.lit(" "), d["content"])).alias("doc_texts")), "query_id", "left")
    r = findings.diagnosis_report(known)
    return r.select("query_id", "ata_chapter", F.size("affected_parts").alias("n_parts"), F.array_join("references", ",").alias("refs"), F.size("recommended_tests").alias("n_tests"), "wiring.has_wiring", "verification_status")


_CHAPTER = r"""case when regexp_matches(diagnosis, 'ATA[:\s]*\d{2}[-\s]\d{2}', 'i') then 'ATA ' || regexp_extract(diagnosis, 'ATA[:\s]*(\d{2})[-\s](\d{2})', 1, 'i') || '-' || regexp_extract(diagnosis, 'ATA[:\s]*(\d{2})[-\s](\d{2})', 2, 'i')
    when regexp_matches(diagnosis, 'ATA Chapter[:\s]*\d{2}', 'i') then 'ATA ' || regexp_extract(diagnosis, 'ATA Chapter[:\s]*(\d{2})', 1, 'i') when regexp_matches(diagnosis, 'ATA[:\s]*\d{2}\b', 'i') then 'ATA ' || regexp_extract(diagnosis, 'ATA[:\s]*(\d{2})\b', 1, 'i') else '' end"""
_PARTS = " union ".join(f"select query_id, unnest(regexp_extract_all(diagnosis, {_sql_text(p.replace('(?i)', ''))}, 1{', ' + repr('i') if '(?i)' in p else ''})) as pn from x" for p, _ in findings.PARTS)
_SENTENCES = f"len(list_filter(list_transform(string_split_regex(diagnosis, '[.!?]'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: length(s) > 20 and {_sql_has('lower(s)', findings.TEST_WORDS)}))"
_CODES = " or ".join(_matches("diagnosis", p) for p in findings.WIRING_CODES)
_add(
    "diagnosis_report", _on(_diagnosis_report, "diagnoses", "retrieved"),
    f"""with x as (select query_id, coalesce(diagnosis, '') as diagnosis from diagnoses), y as (select query_id, string_agg(regexp_replace(upper(string_split(doc_path, '/')[-1]), '\\.XML$', ''), ',' order by k) as refs, bool_or({_sql_has("lower(doc_path || ' ' || content)", findings.WIRING_WORDS)}) as wired from retrieved where score > 0.3 group by query_id),
    z as (select query_id, count(distinct upper(pn)) as n from ({_PARTS}) where length(pn) >= 6 group by query_id)
    select query_id, {_CHAPTER} as ata_chapter, least(coalesce(n, 0), 10) as n_parts, case when len({_REFERENCES}) > 0 then array_to_string({_REFERENCES}, ',') else coalesce(refs, '') end as refs,
    case when {_SENTENCES} = 0 then 3 else least({_SENTENCES}, 6) end as n_tests, coalesce(wired, false) or {_CODES} or {_sql_has('lower(diagnosis)', findings.WIRING_SAID)} as has_wiring, {_STATUS} as verification_status
    from x left join y using (query_id) left join z using (query_id)""",
)


def _stream(spark, d, table: str, shape):
    """A given table as a stream of files, shaped by SQL expressions."""
    schema = spark.read.parquet(f"{d}/{table}.parquet").schema
    # a pattern, since a stream's path may be a folder or a pattern, but no file
    return spark.readStream.schema(schema).parquet(f"{d}/{table}.parque[t]").selectExpr(*shape)


#: Customers as records: opened a minute apart, resolved after up to 99 days, some by others, some not at all.
_OPENED = ("c_custkey as record_id", "c_nationkey as user_id", "timestamp '2001-01-01 00:00:00' + make_dt_interval(0, 0, c_custkey) as started_at")
_RESOLVED = ("c_custkey as record_id", "case when c_custkey % 7 = 0 then c_nationkey + 1 else c_nationkey end as user_id", "case when c_custkey % 5 <> 0 then timestamp '2001-01-01 00:00:00' + make_dt_interval(c_custkey % 100, 0, c_custkey + 10, 30) end as resolved_at")
_AGAIN = ("c_custkey as record_id", "c_nationkey as user_id", "case when c_custkey % 11 = 0 then timestamp '2001-01-01 00:00:00' + make_dt_interval(100, 0, c_custkey) end as resolved_at")


def _downtime_stream(spark, d):
    resolves = _stream(spark, d, "customer", _RESOLVED).unionByName(_stream(spark, d, "customer", _AGAIN))
    stream = streams.downtime(_stream(spark, d, "customer", _OPENED), resolves)
    rows = streams.latest_downtime(streams.run_to_table(stream, streams.shared_folder(spark, "downtime"), "update"))
    return rows.select("record_id", "user_id", "downtime_minutes")


_add(
    "downtime_stream", _downtime_stream,
    """with r as (select c_custkey as k, c_nationkey as u, case when c_custkey % 11 = 0 then 100 * 1440 when c_custkey % 5 <> 0 and c_custkey % 7 <> 0 then (c_custkey % 100) * 1440 + 11 end as minutes from customer)
    select k as record_id, u::bigint as user_id, minutes as downtime_minutes from r where minutes is not null""",
)


def _recurrence_stream(spark, d):
    shape = (f"{ata('l_partkey')} as ata_code", "cast(l_shipdate as timestamp) as occurrence_date", "l_returnflag")
    faults = _stream(spark, d, "lineitem", shape).where("l_returnflag = 'R'").drop("l_returnflag")
    return streams.recurrence(streams.run_to_table(streams.daily_panes(faults), streams.shared_folder(spark, "panes")))


_add(
    "recurrence_stream", _recurrence_stream,
    """with p as (select ata_code, cast(occurrence_date as date) as day, count(*) as n from occurrences where cast(occurrence_date as date) + 1 <= (select max(occurrence_date) - interval 1 day from occurrences) group by 1, 2)
    select ata_code, day, (select sum(n) from p b where b.ata_code = p.ata_code and b.day > p.day - 30 and b.day <= p.day)::bigint as n30, (select sum(n) from p b where b.ata_code = p.ata_code and b.day > p.day - 60 and b.day <= p.day)::bigint as n60,
    (select sum(n) from p b where b.ata_code = p.ata_code and b.day > p.day - 90 and b.day <= p.day)::bigint as n90 from p""",
)


_DOCUMENT = "replace(replace(replace(string_split(doc_path, '/')[-1], 'dmc-', ''), '.xml', ''), '.pdf', '')"
_DMC = f"regexp_extract(doc_path, {_sql_text(text.DMC)}, 0)"
_PATHS = "(select doc_id, doc_path from corpus union all select doc_id, doc_path from manuals union all select doc_id, 'xml_data/dmc-short' from manuals)"
_add(
    "dmc_codes",
    _on(lambda c, m: c.select("doc_id", "doc_path").unionByName(m.select("doc_id", "doc_path")).unionByName(m.select("doc_id", F.lit("xml_data/dmc-short").alias("doc_path"))).select("doc_id", text.dmc_code(F.col("doc_path")).alias("code")), "corpus", "manuals"),
    f"select doc_id, case when {_DMC} <> '' then {_DMC} when length({_DOCUMENT}) > 10 and contains({_DOCUMENT}, '-') then {_DOCUMENT} else '' end as code from {_PATHS}",
)
_EACH_PART = "list_concat(" * (len(findings.PARTS) - 1) + ", ".join(f"regexp_extract_all(diagnosis, {_sql_text(p.replace('(?i)', ''))}, 1{', ' + repr('i') if '(?i)' in p else ''})" + (")" if i else "") for i, (p, _) in enumerate(findings.PARTS))
_add(
    "affected_parts", _on(lambda d: d.select("query_id", F.array_join(F.transform(findings.part_numbers(F.col("diagnosis")), lambda r: r["part_number"]), ",").alias("parts")), "diagnoses"),
    f"with x as (select query_id, list_filter(list_transform({_EACH_PART}, lambda w: upper(w)), lambda w: length(w) >= 6) as pn from (select query_id, coalesce(diagnosis, '') as diagnosis from diagnoses)) select query_id, coalesce(array_to_string(list_filter(pn, lambda w, i: list_position(pn, w) = i)[1:10], ','), '') as parts from x",
)
_CLASSES = ", ".join(f"case when {_matches('diagnosis', p)} then '{c}' end" for p, c in findings.CAUSE_CLASSES)
_add(
    "cause_classes", _on(lambda d: d.select("query_id", F.array_join(F.transform(findings.causes_by_keyword(F.col("diagnosis")), lambda r: F.concat_ws(":", r["cause"], r["probability"])), ";").alias("causes")), "diagnoses"),
    f"with x as (select query_id, list_filter([{_CLASSES}], lambda c: c is not null)[1:3] as hits from (select query_id, coalesce(diagnosis, '') as diagnosis from diagnoses)) select query_id, case when len(hits) = 0 then 'Further investigation required:30' else array_to_string(list_transform(hits, lambda c, i: c || ':' || cast(45 - 10 * i as int)), ';') end as causes from x",
)
_add("active_experts", _on(lambda e: records.active_experts(e, "tenant 2").select("id", "name"), "experts"), "select id, name from experts where tenant_id = 'tenant 2' and available = 1 and deleted_at is null")
_add(
    "escalations", _on(lambda a, b: records.escalations(a, b).select("id", "ata", F.concat_ws(",", F.transform("bookings", lambda x: F.concat_ws(":", x["id"], x["expert_id"], x["status"]))).alias("booked")), "assessed", "bookings"),
    "select a.id, a.ata, coalesce(booked, '') as booked from assessed a left join (select query_id, string_agg(concat(id, ':', expert_id, ':', status), ',' order by id, expert_id, status) as booked from bookings group by query_id) b on b.query_id = a.id where certainty_status = 'REQUIRE_EXPERT'",
)
_add(
    "quick_checks", _on(lambda p, a, r, c: records.quick_check(p, eff.applicable_codes(a, r, c)), "pasted", "aircraft", "part_code_ranges", "part_codes"),
    f"""with known as (select distinct serial, h.code as token from {_HITS} h join part_codes c on c.code = h.code where is_deleted = 0),
    t as (select serial, configuration, unnest(list_distinct(list_transform(list_filter(string_split_regex(pasted, '[\s,;]+'), lambda w: w <> ''), lambda w: regexp_replace(upper(w), '^\*+', '')))) as token from pasted)
    select t.serial, t.token, case when t.token in ('SN', 'LN', 'EN', 'ENH', 'EP', 'PLUS') then case t.token when 'EN' then 'ENH' when 'EP' then 'PLUS' else t.token end = configuration else k.token is not null end as applies from t left join known k on k.serial = t.serial and k.token = t.token""",
)
_add(
    "parsed_ranges", _on(lambda r: r.select("id", F.array_join(F.transform(catalogue.parse_ranges(F.col("said")), lambda x: F.concat_ws("-", x["serial_start"], x["serial_end"])), ",").alias("ranges")), "range_texts"),
    f"select id, case kind when 0 then concat(a, '-', b) when 1 then concat(a, '-', {catalogue.OPEN_END}) when 2 then concat({catalogue.OPEN_START}, '-', b) when 3 then concat(a, '-', {catalogue.OPEN_END}) when 4 then concat(a, '-', a, ',', b, '-', b) when 5 then case when a = b then concat(a, '-', a) else concat(a, '-', a, ',', b, '-', b) end end as ranges from range_texts",
)
_add("first_codes", _on(lambda r: records.first_code(r.selectExpr("code", "serial_start position")), "part_code_ranges"), "select code, min(serial_start) as position from part_code_ranges group by code")
_add("new_documents", _on(lambda m, q: tables.new_documents(m.selectExpr("doc_id", "doc_path path"), m.join(q, F.col("doc_id") == F.col("query_id"), "left_semi").select("doc_path")), "manuals", "questions"), "select doc_id, doc_path as path from manuals where doc_path not in (select doc_path from manuals join questions on doc_id = query_id)")


def _conversation_texts(spark, d):
    talk = spark.read.parquet(f"{d}/conversations.parquet")
    return tables.page_text(talk.selectExpr("conv_id path", "turn page", "text")).select(F.col("path").alias("conv_id"), "text")


_add("conversation_texts", _conversation_texts, "select conv_id, coalesce(string_agg(text, chr(10) order by turn, text), '') as text from conversations group by conv_id")
