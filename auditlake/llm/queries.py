"""Queries of the llm operators and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import copies, credentials, handwritten, packing, reading, repeats, syntax, tokens
from auditlake.storage import staged, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "sources"), table(spark, d, "repositories"))


def p1_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Files by language and kind."""
    found = handwritten.kinds(table(spark, d, "sources"), table(spark, d, "repositories"))
    return found.groupBy("language", "kind").agg(F.count(F.lit(1)).alias("files"), F.avg("mean_line").alias("mean_line"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return repeats.repeats(table(spark, d, "baseline_entries")).select("first_entry_id", "entry_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.invalid(table(spark, d, "sources"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(table(spark, d, "sources"), elements=True)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "baseline_raw"))


def p4_kept(spark: SparkSession, d: str) -> DataFrame:
    return copies.kept(table(spark, d, "baseline_raw"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.lines(table(spark, d, "sources"), table(spark, d, "observations"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(table(spark, d, "sources"), table(spark, d, "observations"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokens.round_trip(table(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = staged(tokens.token_counts(table(spark, d, "documents")), "p7-sizes")
    return packing.packed(sizes, table(spark, d, "pack_limits"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.container_fill(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.difficulty(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "reading_level")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return reading.profile(reading.difficulty(documents, table(spark, d, "reading_labels")), documents)


_BARE = r"regexp_replace(replace(lower({x}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', '', 'g')"
_FIELDS = f"""list_sort(list_transform(json_keys(fields_json), lambda k:
  {_BARE.format(x="k")} || chr(3) || coalesce({_BARE.format(x="json_extract_string(fields_json, '$.' || json_quote(k)::varchar)")}, chr(4))))"""
_CANON = f"""with c as (select record_id, min(record_id) over w first_record_id, count(*) over w copies from (
  select record_id, {_BARE.format(x="fingerprint")} f, {_BARE.format(x="snippet")} s, {_FIELDS} j from baseline_raw)
  window w as (partition by f, s, j))"""


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_BARE_SNIPPET = rf"regexp_replace(snippet, {_sql(repeats.COMMENT)}, '\1 ', 'g')"
_FINGERPRINT = r"case when regexp_matches(lower(trim(fingerprint)), '^[0-9a-f]{16,}$') and len(list_distinct(string_split(lower(trim(fingerprint)), ''))) > 1 then substr(lower(trim(fingerprint)), 1, 15) end"
_PLACE = r"""[coalesce('=' || repository_id, '-'), coalesce('=' || lower(trim(rule_id)), '-'), coalesce('=' || lower(trim(regexp_extract(replace(file_path, '\', '/'), '[^/]*$'))), '-')]"""
_COMMON = "len(list_intersect(o.words, h.words))"
_ONLY_O, _ONLY_H = f"len(o.words) - {_COMMON}", f"len(h.words) - {_COMMON}"
_NEAR = f"{_COMMON} / cast(len(o.words) + len(h.words) - {_COMMON} as double)"


def _repeats_sql(batches: int = 12) -> str:
    """Every statement of a batch against every accepted one of its place, batch after batch."""
    steps = ["a0 as materialized (select * from own where batch_no = 0)"]
    for n in range(1, batches):
        steps.append(f"""h{n} as materialized (select own_id, max_by(first_id, [score, same, -first_id]) as first_id from (select o.own_id, h.own_id as first_id, {_NEAR} as score, cast(coalesce(o.fp = h.fp, false) as double) as same
    from own o join a{n - 1} h on h.place = o.place where o.batch_no = {n} and {_NEAR} >= 0.6 and ({_ONLY_O} + {_ONLY_H} <= 4 or least({_ONLY_O}, {_ONLY_H}) <= 1 and greatest({_ONLY_O}, {_ONLY_H}) <= 4)) group by 1)""")
        steps.append(f"a{n} as materialized (select * from a{n - 1} union all select o.* from own o where o.batch_no = {n} and not exists (select 1 from h{n} where h{n}.own_id = o.own_id))")
    hits = " union all ".join(f"select * from h{n}" for n in range(1, batches))
    return rf"""with w as materialized (select entry_id, batch_no, place, fp, list_sort(list_distinct(case when len(found) > 0 then found when rest != '' then [rest] else [] end)) as words from (select entry_id, batch_no, {_PLACE} as place, {_FINGERPRINT} as fp,
      list_transform(regexp_extract_all(regexp_replace({_BARE_SNIPPET}, '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), {_sql(repeats.WORD.replace("(?!" + chr(92) + "p{Ll})", ""))}), lambda x: lower(x)) as found, regexp_replace({_BARE_SNIPPET}, '\s+', '', 'g') as rest from baseline_entries where snippet is not null)),
    own as materialized (select batch_no, place, words, min(entry_id) as own_id, min(fp) as fp from w where len(words) > 0 group by all), {", ".join(steps)}
    select t.first_id as first_entry_id, w.entry_id from ({hits}) t join own using (own_id) join w on w.batch_no = own.batch_no and w.place = own.place and w.words = own.words"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_kinds": p1_kinds, "p2_found": p2_found, "p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p4_kept": p4_kept, "p5_found": p5_found, "p5_redacted": p5_redacted, "p6_ids": p6_ids, "p6_round_trip": p6_round_trip, "p7_containers": p7_containers, "p7_fill": p7_fill, "p8_found": p8_found, "p8_profile": p8_profile}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _repeats_sql(),
        "p4_found": f"{_CANON} select first_record_id, record_id from c where first_record_id < record_id",
        "p4_kept": f"{_CANON} select record_id, copies from c where first_record_id = record_id",
    }
