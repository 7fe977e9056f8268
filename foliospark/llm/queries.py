"""The queries of the ten text problems, by name. Each takes (spark, folder of tables)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import history
from .distinctive import keyword_scores, term_scores
from .language import LanguageSearch, label_code, long_enough
from .leakage import LeakageSearch
from .markup import clean_markup, residue
from .mixing import Mixture
from .neardup import NearDuplicates
from .scans import ScanRepair
from .sentences import split_sentences
from .split import split_oversized


def _repeats(spark: SparkSession, d: str) -> DataFrame:
    return history.check(table(spark, d, "ingestion_manifest"), table(spark, d, "chunks"), shingle=3, similarity=0.6, min_words=30)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _repeats(spark, d).where("earlier_record_id is not null").select("earlier_record_id", "record_id")


def p1_status(spark: SparkSession, d: str) -> DataFrame:
    """Every record of a later batch as new or as repeating an earlier one."""
    return _repeats(spark, d).select("record_id", "earlier_record_id", F.when(F.col("earlier_record_id").isNull(), "new").otherwise("repeat").alias("outcome"))


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    return clean_markup(table(spark, d, "chunks"), "chunk_id", "chunk_text", F.col("metadata.source_type")).select(F.col("id").alias("chunk_id"), "clean_text", "markups")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "chunks"), "chunk_id", "chunk_text", F.col("metadata.source_type")).select(F.col("id").alias("chunk_id"), "markup")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    near = NearDuplicates(shingle=3, similarity=0.6, min_words=30)
    return near.pairs(table(spark, d, "chunks"), "chunk_id", "chunk_text").select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return NearDuplicates().groups(table(spark, d, "chunks"), "chunk_id", "chunk_text").withColumnRenamed("id", "chunk_id")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "chunks"), "chunk_id", "chunk_text", {"section": F.col("metadata.section")}, size=900, overlap=75)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).where("piece_no = 1").select("chunk_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    held = keyword_scores(table(spark, d, "chunks"), table(spark, d, "queries"), most_share=0.02, rare=True).where("distinctive")
    return held.groupBy("query_id", F.col("id").alias("chunk_id")).agg(F.count("*").alias("n")).where("n >= 2").select("query_id", "chunk_id")


def p5_keywords(spark: SparkSession, d: str) -> DataFrame:
    return keyword_scores(table(spark, d, "chunks"), table(spark, d, "queries")).withColumnRenamed("id", "chunk_id")


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    return term_scores(table(spark, d, "chunks"), "chunk_id", "chunk_text").withColumnRenamed("id", "chunk_id")


def p6_sentences(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "chunks"), "chunk_id", "chunk_text").withColumnRenamed("id", "chunk_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    spoken = table(spark, d, "chunks").where("metadata.source_type = 'youtube_transcript'")
    return split_sentences(spoken, "chunk_id", "chunk_text", texts=False).select(F.col("id").alias("chunk_id"), "start_pos")


def _scans(spark: SparkSession, d: str) -> ScanRepair:
    return ScanRepair(table(spark, d, "chunks"), "chunk_id", "chunk_text", F.col("metadata.page_start"), F.col("metadata.page_end"), F.col("document_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).noise().select(F.col("id").alias("chunk_id"), "noise")


def p7_repaired(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).repaired().select(F.col("id").alias("chunk_id"), "repaired")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    met = LeakageSearch(table(spark, d, "eval_passages")).search(table(spark, d, "documents"))
    return met.where("verbatim > 0").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


def p8_templates(spark: SparkSession, d: str) -> DataFrame:
    """Passages that a document holds with other names or numbers only."""
    met = LeakageSearch(table(spark, d, "eval_passages")).templates(table(spark, d, "documents"))
    return met.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "windows")


def _mixture(spark: SparkSession, d: str) -> Mixture:
    return Mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares().where("short").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares()


def p9_plan(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).plan().withColumnRenamed("id", "doc_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    long = LanguageSearch(docs).stretches(docs, keep={"label": label_code(F.col("lang"))}).where(long_enough())
    return long.where(~F.col("lang_code").eqNullSafe(F.col("label"))).select(F.col("id").alias("doc_id"), "lang_code").distinct()


def p10_stretches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return LanguageSearch(docs).stretches(docs).withColumnRenamed("id", "doc_id")


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return LanguageSearch(docs).languages(docs).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_status, p2_found, p2_clean, p3_found, p3_groups, p4_found, p4_pieces, p5_found, p5_keywords, p5_terms, p6_found, p6_sentences, p7_found, p7_repaired, p8_found, p8_templates, p9_found, p9_shares, p9_plan, p10_found, p10_stretches, p10_languages)}

_WORDS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}\p{{M}}]*')"
_VISIBLE = r"regexp_replace(text, '[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]', '', 'g')"
#: Rows (t, w) in the table named src, to pairs (a, b) of t whose sets of three-word shingles overlap by 0.6.
_SIMILAR = """sh as (select distinct t, hash(w[i:i + 2]) as h from (select t, w, unnest(range(1, len(w) - 1)) as i from src where len(w) >= 30)), sz as (select t, count(*) as n from sh group by t),
sim as (select x.t as a, y.t as b from sh x join sh y using (h) join sz sx on sx.t = x.t join sz sy on sy.t = y.t where x.t < y.t group by x.t, y.t, sx.n, sy.n having count(*) / (sx.n + sy.n - count(*)) >= 0.6)"""
ORACLES: dict[str, str] = {
    "p1_found": f"""with c as (select distinct document_id, chunk_id, chunk_text, metadata.chunk_index as i from chunks), dt as (select document_id, string_agg(coalesce(chunk_text, ''), ' ' order by i, chunk_id) as text from c group by 1),
src as (select document_id as t, {_WORDS.format(x='text')} as w from dt), {_SIMILAR}, both_ as (select a, b from sim union all select b, a from sim),
m as (select distinct record_id, batch_no, document_id, nullif(regexp_replace(lower(trim(file_hash)), '^sha256:', ''), '') as h, coalesce(lower(trim(status)) = 'success', false) as ok, batch_no * 1000000000000 + record_id as ord_ from ingestion_manifest),
r as (select l.record_id, e.ord_ from m l join m e on e.ok and e.h = l.h and e.ord_ < l.ord_ where l.batch_no >= 1 union all select l.record_id, e.ord_ from m l join both_ on both_.a = l.document_id join m e on e.document_id = both_.b and e.ok and e.ord_ < l.ord_ where l.batch_no >= 1)
select min(ord_) % 1000000000000 as earlier_record_id, record_id from r group by record_id""",
    "p3_found": f"""with src as (select distinct chunk_id as t, {_WORDS.format(x='chunk_text')} as w from chunks where chunk_text is not null), {_SIMILAR} select a as chunk_id_a, b as chunk_id_b from sim""",
    "p4_found": r"select distinct chunk_id from chunks where length(regexp_replace(chunk_text, '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+\z', '', 'g')) > 900",
    "p5_found": f"""with c as (select distinct chunk_id, chunk_text from chunks where trim(chunk_text, ' ' || chr(9) || chr(10) || chr(13)) <> ''), w as (select chunk_id, ' ' || array_to_string({_WORDS.format(x='chunk_text')}, ' ') || ' ' as t from c),
k as (select distinct query_id, keyword, ' ' || array_to_string({_WORDS.format(x='keyword')}, ' ') || ' ' as p from (select id as query_id, lower(trim(unnest(expected_keywords))) as keyword from queries) where keyword <> ''),
h as (select p, chunk_id from (select distinct p from k where trim(p) <> '') join w on contains(t, p)), d as (select p from h group by p having count(*) <= 0.02 * (select count(*) from c))
select query_id, chunk_id from k join d using (p) join h using (p) group by all having count(*) >= 2""",
    "p8_found": f"""with d as (select doc_id, {_WORDS.format(x=_VISIBLE)} as w from documents), e as (select item_id, {_WORDS.format(x=_VISIBLE)} as w from eval_passages),
dw as (select doc_id, array_to_string(w[i:i + 12], ' ') as r from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)), ew as (select distinct item_id, array_to_string(w[i:i + 12], ' ') as r from (select item_id, w, unnest(range(1, len(w) - 11)) as i from e where len(w) >= 13))
select distinct doc_id, item_id from dw join ew using (r)""",
    "p9_found": """with s as (select lower(trim(source)) as k, sum(length(coalesce(text, ''))) as n from documents group by 1), t as (select m.*, coalesce(n, 0) as n from mix_targets m left join s on k = lower(trim(m.source))) select source from t where n * max_repeats < target_share * (select sum(n) from t)""",
}
ORACLES["p1_status"] = f"with found as ({ORACLES['p1_found']}), l as (select distinct record_id from ingestion_manifest where batch_no >= 1) select l.record_id, earlier_record_id, case when earlier_record_id is null then 'new' else 'repeat' end as outcome from l left join found using (record_id)"
