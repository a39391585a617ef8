"""Domain tables derived from the test tables by SQL that Spark and DuckDB read alike.

``{name}`` stands for a base table. Everything is arithmetic on keys, so both engines give
equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def ata(k: str) -> str:
    return f"substr('2124293234717228', cast(1+2*(({k})%8) as int), 2)"


def serial(k: str) -> str:
    return f"cast(31000+(({k})*37)%31000 as varchar(10))"


def part(k: str) -> str:
    return f"concat('3G', lpad(cast({k} as varchar(10)),6,'0'))"


VIEWS = {
    "occurrences": f"select l_orderkey*10+l_linenumber as id, {ata('l_partkey')} as ata_code, {serial('l_suppkey')} as aircraft_serial, cast(l_shipdate as timestamp) as occurrence_date, concat('fault on ', l_returnflag, l_linestatus) as issue_summary, case when l_linenumber=3 then null else cast(l_quantity as int) end as days_to_resolution from {{lineitem}} where l_returnflag='R'",
    "parts": f"select {part('p_partkey')} as part_number, p_name as description, {ata('p_partkey')} as ata_code, coalesce(n,0) as times_replaced, p_size as failure_rate from {{part}} left join (select l_partkey, count(*) as n from {{lineitem}} where l_returnflag='R' group by l_partkey) c on l_partkey=p_partkey",
    "replacements": f"select l_orderkey*10+l_linenumber as id, l_orderkey as troubleshooting_id, {part('l_partkey')} as part_on_pn, concat({part('l_partkey')}, '-OLD') as part_off_pn, {ata('l_partkey')} as ata_code, cast(l_quantity as int) as quantity, cast(l_shipdate as timestamp) as replaced_at from {{lineitem}} where l_returnflag='R'",
    "downtime": f"select o_orderkey as id, o_custkey as user_id, o_orderkey as diagnostic_query_id, {serial('o_custkey')} as aircraft_serial, {ata('o_orderkey')} as ata_code, cast(o_orderdate as timestamp) as diagnosis_started_at, case when o_orderstatus='O' then 'open' else 'resolved' end as status, case when o_orderstatus='O' then null else cast(floor(o_totalprice/100) as int) end as downtime_minutes from {{orders}}",
    "history": f"select doc_id as id, {serial('doc_id')} as aircraft_serial, {ata('doc_id')} as ata, text as problem, case when doc_id%3=0 then 'pending' else 'resolved' end as solution_status, case when doc_id%3=0 then null else doc_id end as resolved_seq from {{documents}}",
    "problems": f"select item_id as query_id, text as problem, {serial('item_id')} as serial_number, case when item_id%5=0 then null else {ata('item_id')} end as ata from {{benchmark}}",
    "aircraft": f"select c_custkey as aircraft_id, case when c_custkey%97=0 then 'N/A' else concat('S/N ', {serial('c_custkey')}) end as serial_number from {{customer}}",
    "part_codes": "select concat('E', lpad(cast(s_suppkey as varchar(10)),4,'0')) as code, s_name as description, case when s_suppkey%50=7 then 1 else 0 end as is_deleted, case when s_suppkey%40=3 then 1 else 0 end as is_conditional from {supplier}",
    "part_code_ranges": "select concat('E', lpad(cast(s_suppkey as varchar(10)),4,'0')) as code, 31000+(s_suppkey*997+k*4001)%30000 as serial_start, case when s_suppkey%20=0 and k=2 then 99999 else 31000+(s_suppkey*997+k*4001)%30000+(s_suppkey*31)%500 end as serial_end from {supplier} cross join (select 0 as k union all select 1 union all select 2) ks where s_suppkey%25<>9",
    "part_effectivity": f"select {part('p_partkey')} as part_number, c as configuration_code, case when (p_partkey+i)%3=0 then 0 else 1 end as is_applicable from {{part}} cross join (select 0 as i, 'SN' as c union all select 1, 'LN' union all select 2, 'ENH' union all select 3, 'PLUS') cs where (p_partkey+i)%4<>0",
    "corpus": f"select doc_id, concat('xml_data/dmc-39-A-', {ata('doc_id')}, '-', lpad(cast(doc_id%100 as varchar(10)),2,'0'), '-00-00A-', lpad(cast(doc_id%1000 as varchar(10)),3,'0'), 'A-A.xml') as doc_path, embedding, text from {{documents}} join {{embeddings}} on vec_id=doc_id",
    "manuals": f"select doc_id, concat('xml_data/dmc-39-A-', case when doc_id%13=0 then 'AWDP' else {ata('doc_id')} end, '-0', cast(doc_id%10 as varchar(1)), '-00A-', lpad(cast(doc_id%1000 as varchar(10)),3,'0'), 'A-A.xml') as doc_path, embedding, concat(text, case doc_id%12 when 0 then ' The engine will not start. Start sequence of the starter generator before engine start.' when 1 then ' Fault isolation: does not start, crank the engine' when 2 then ' GEN HOT caution, temperature' when 3 then ' See the Wiring Diagram of the compressor' when 4 then ' Fault isolation of hot bleed air' when 5 then ' not starting: start cycle' when 6 then ' wiring data of the fuselage' when 7 then ' airframe structure' when 8 then ' airframe and cabin' when 10 then ' fuselage' when 11 then ' cabin door' else '' end) as text from {{documents}} join {{embeddings}} on vec_id=doc_id",
    "questions": f"select item_id as query_id, concat(text, case item_id%11 when 0 then ' The engine does not start' when 1 then ' generator will not start' when 2 then ' starter not starting, overheat' when 3 then ' electrical fault of the connector' when 4 then ' hot start' when 5 then ' generator not working' when 6 then ' wiring pin' else '' end) as query, embedding, case item_id%9 when 0 then null when 1 then 'PT6C_67CD' when 2 then 'PRIMUS_EPIC' when 3 then 'AW139_AIRFRAME' when 4 then '88' when 5 then 'general' when 6 then '' else {ata('item_id')} end as filter from {{benchmark}} join {{embeddings}} on vec_id=item_id",
    "maintenance_logs": f"select o_orderkey as id, {serial('o_custkey')} as aircraft_serial, {ata('o_orderkey')} as ata, o_orderpriority as type, cast(o_orderdate as timestamp) as log_date, cast(floor(o_totalprice/10) as int) as tsn from {{orders}} where o_orderstatus='F'",
    "diagnoses": f"select doc_id as query_id, {ata('doc_id')} as ata, case when doc_id%17=3 then 'ATA 24' when doc_id%9=0 then 'AW139_AIRFRAME' when doc_id%9=1 then 'PT6C_67CD' when doc_id%9=2 then 'ATA 77' when doc_id%9=3 then '05' when doc_id%9=4 then null else {ata('doc_id')} end as chosen, case when doc_id%17=3 then 'none' when doc_id%23=5 then 'empty' else {ata('doc_id')} end as pool, case when doc_id%17=4 then 'install_procedure' when doc_id%17=5 then 'fault_isolation' when doc_id%6=0 then 'remove_procedure' when doc_id%6=1 then 'other' when doc_id%6=2 then 'operational_test' when doc_id%6=3 then 'system_description' else 'fault_isolation' end as task_type, doc_id%4<>1 as has_wiring, case when doc_id%17=4 then 'how to remove and install the fuel pump' when doc_id%17=5 then 'generator does not start engine' when doc_id%5=0 then 'generator does not start' when doc_id%5=1 then 'nose wheel steering stuck on ground' when doc_id%5=2 then 'how to replace the fuel pump' when doc_id%5=3 then 'ok?' else null end as query, concat(text, case when doc_id%2=0 then ' . Replace P/N 3G2400A00131 of the starter relay, see AMM 24-30-00' else '' end, case when doc_id%3=0 then ' . 45% worn brush of the starter' else '' end, case when doc_id%4=0 then ' . Measure 28 V at connector J12 because the contactor fails to close' else '' end, case when doc_id%5=0 then ' . ATA 24-30 and 39-A-24-30-00-00A-520A-A' else '' end, case when doc_id%7=0 then ' . First remove the panel, then check continuity of the wiring' else '' end, case when doc_id%11=0 then chr(10) || '1. go on' || chr(10) || '2. AWD 24' else '' end, case when doc_id%17=5 then ' . First, in short: the system works by power flow from the generator and battery bus through the starter relay to the engine. Signal path: from the switch to the contactor, pin 12 of connector J3. It does not start because the contactor fails to close: 80% probability of a worn brush, 20% corroded relay. Electrical circuit of the left panel. AMM 24-30-00, AWD 24, P/N 3G2400A00131 and 39-A-24-30-00-00A-520A-A. Measure 28 V, 5 A, 30 psi, 10 mm.' || chr(10) || '1. Open the panel' when doc_id%17=4 then ' . Step 1: remove the fuel pump with a torque wrench, 20 Nm. Caution: depressurize before removing. Then clean and install the new fuel pump, torque 15 Nm, 30 psi, 5 mm, 28 V and 2 A, see AMM 28-20-00 and 39-A-28-20-00-00A-520A-A.' || chr(10) || '1. Remove the fuel tank cover' else '' end, ' .') as diagnosis from {{documents}}",
    "experts": "select c_custkey as id, c_name as name, concat('tenant ', cast(c_nationkey % 5 as varchar(2))) as tenant_id, case when c_custkey%3=0 then 0 else 1 end as available, case when c_custkey%7=0 then 'gone' else null end as deleted_at from {customer}",
    "assessed": f"select o_orderkey as id, {ata('o_orderkey')} as ata, case when o_orderstatus='O' then 'REQUIRE_EXPERT' else 'SAFE_TO_PROCEED' end as certainty_status from {{orders}}",
    "bookings": "select l_orderkey*10+l_linenumber as id, l_orderkey as query_id, l_suppkey as expert_id, l_linestatus as status from {lineitem} where l_returnflag<>'A'",
    "pasted": f"select c_custkey as request_id, 31000+(c_custkey*37)%31000 as serial, case c_custkey%4 when 0 then 'SN' when 1 then 'LN' when 2 then 'ENH' else 'PLUS' end as configuration, concat(' *E', lpad(cast(c_custkey%200 as varchar(10)),4,'0'), ', ln;', case when c_custkey%2=0 then 'EN  ' else 'ep' || chr(10) end, '**e', lpad(cast((c_custkey*7)%200 as varchar(10)),4,'0'), ' E9999 ln') as pasted from {{customer}}",
    "range_texts": "select l_orderkey*10+l_linenumber as id, l_partkey as a, l_partkey+l_suppkey as b, (l_orderkey+l_linenumber)%6 as kind, case (l_orderkey+l_linenumber)%6 when 0 then concat('S/N ', l_partkey, ' thru ', l_partkey+l_suppkey) when 1 then concat('from s/n ', l_partkey, ' thru TBD') when 2 then concat('S/N TBD thru ', l_partkey+l_suppkey) when 3 then concat('S/N ', l_partkey, ' and subsequent') when 4 then concat('S/N  ', l_partkey, ' and ', l_partkey+l_suppkey, ' only') else concat('S/N ', l_partkey, ', S/N ', l_partkey+l_suppkey, ', S/N ', l_partkey) end as said from {lineitem}",
    "retrieved": "select doc_id as query_id, k, concat('xml_data/dmc-39-a-', case when (doc_id+k)%4=0 then '05' else '24' end, '-01-00a-', cast(k as varchar(1)), '.xml') as doc_path, case when k%2=0 then 'the engine and cabin' else 'airframe' end as content, cast((doc_id*7+k*5)%100 as double)/100 as score from {documents} cross join (select 0 as k union all select 1 union all select 2 union all select 3 union all select 4) ks",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"\{(\w+)\}", VIEWS[name]))}
    return spark.sql(VIEWS[name], **tables)


def spread(df: DataFrame) -> DataFrame:
    """For much work on each row: a table of fewer parts than the cluster has cores is dealt to all of them; others stay where they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def duck(sql: str) -> str:
    """An oracle: the SQL with each view that it names put before it."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    named = ", ".join(f"{n} as ({re.sub(r'[{}]', '', VIEWS[n])})" for n in used)
    more = sql.removeprefix("with ")
    return sql if not used else f"with {named}, {more}" if more != sql else f"with {named} {sql}"
