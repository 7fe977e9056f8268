"""All queries of the library by name, and the SQL that says what each has to return.

Queries are functions of a session and a folder of tables; all run over whole tables. The SQL is for DuckDB, over views of the same
names. Numbers are rounded to six places on both sides.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scoring as S
from ..functions import text as T
from ..operators import answers, chunking, dense, embedding, evaluation, hybrid, lexical, listing, manifest, pages, store
from ..session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "hybrid_topk"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# What both sides share. Spark: distinct chunks; DuckDB: the view u.
U = "with u as (select distinct chunk_id, chunk_text from chunks)"
UM = "with u as (select distinct chunk_id, chunk_text, metadata from chunks)"
WS = r"[ \t\n\r\x0b\x0c]"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "chunk_text").distinct()


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "chunk_text", "document_id", "metadata").dropDuplicates(["chunk_id"])


def _sql_canonical(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '\n\z', '')"


def _sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+\z', '', 'g')"


def _sql_lines(x: str) -> str:
    return f"string_split({_sql_canonical(x)}, chr(10))"


def _sql_join(x: str) -> str:
    return f"array_to_string({x}, chr(10))"


def _sql_weird(x: str) -> str:
    return rf"(regexp_matches({x}, '[a-z][A-Z]') or len(list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: regexp_matches(substring(w, 2), '[A-Z]') and regexp_matches(w, '[a-z]'))) > 0)"


def _sql_comments(x: str) -> str:
    return rf"regexp_replace({x}, '<!--[^\n]*?-->', '', 'g')"


def _sql_images(x: str) -> str:
    kept = rf"list_filter({_sql_lines(x)}, lambda l: not regexp_matches({_sql_strip('l')}, '(?i)^(<!--[ \t]*image[ \t]*-->|\[image\])\z'))"
    return rf"regexp_replace({_sql_join(kept)}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def _sql_rstrip(x: str) -> str:
    return rf"regexp_replace({_sql_canonical(x)}, '[ \t]+(\n|\z)', '\1', 'g')"


def _sql_spaces(x: str) -> str:
    return _sql_strip(rf"regexp_replace(regexp_replace(replace({x}, chr(9), ' '), ' +', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def _sql_headers(x: str) -> str:
    return rf"regexp_replace({_sql_canonical(x)}, '(^|\n)(#{{1,6}})([^\s#])', '\1\2 \3', 'g')"


_LIST = r"^([-*] |[0-9]+\.([ \t]|\z))"


def _sql_wraps(lines: str) -> str:
    """Of a column that holds stripped lines."""
    alone = lambda y: f"({y} = '' or regexp_matches({y}, '{_LIST}'))"
    prev, here = f"{lines}[i - 1]", f"{lines}[i]"
    mark = rf"case when i = 1 then '' when {alone(here)} or {alone(prev)} or regexp_matches({prev}, '[.:?!]\z') then chr(10) else ' ' end"
    return f"array_to_string(list_transform(range(1, len({lines}) + 1), lambda i: {mark} || {here}), '')"


def _sql_noise(x: str) -> str:
    s = _sql_strip("l")
    noise = rf"(regexp_matches({s}, '^[!-/:-@\[-`{{-~]+\z') or contains({s}, '<!--') or (not contains({s}, ' ') and length({s}) > 15 and {_sql_weird(s)}))"
    return _sql_join(f"list_transform(list_filter({_sql_lines(x)}, lambda l: not {noise}), lambda l: case when {s} = '' then '' else l end)")


_CLEAN = f""", c1 as (select *, {_sql_comments("coalesce(chunk_text, '')")} as a from u), c2 as (select *, {_sql_images("a")} as b from c1),
c3 as (select *, {_sql_rstrip("b")} as c from c2), c4 as (select *, {_sql_spaces("c")} as d from c3), c5 as (select *, {_sql_headers("d")} as e from c4),
c6 as (select *, list_transform({_sql_lines("e")}, lambda l: {_sql_strip("l")}) as f from c5), c7 as (select *, {_sql_wraps("f")} as g from c6), cleaned as (select *, {_sql_noise("g")} as clean from c7)"""


# cleaning


@query(f"{U} select chunk_id, {_sql_comments('chunk_text')} as result from u")
def clean_html_comments(spark, d):
    return _texts(spark, d).select("chunk_id", T.remove_html_comments(F.col("chunk_text")).alias("result"))


@query(f"{U} select chunk_id, {_sql_images('chunk_text')} as result from u")
def clean_image_lines(spark, d):
    return _texts(spark, d).select("chunk_id", T.remove_image_lines(F.col("chunk_text")).alias("result"))


@query(f"{U} select chunk_id, {_sql_rstrip('chunk_text')} as result from u")
def clean_rstrip(spark, d):
    return _texts(spark, d).select("chunk_id", T.rstrip_lines(F.col("chunk_text")).alias("result"))


@query(f"{U} select chunk_id, {_sql_spaces('chunk_text')} as result from u")
def clean_whitespace(spark, d):
    return _texts(spark, d).select("chunk_id", T.normalize_whitespace(F.col("chunk_text")).alias("result"))


@query(f"{U} select chunk_id, {_sql_headers('chunk_text')} as result from u")
def clean_md_headers(spark, d):
    return _texts(spark, d).select("chunk_id", T.space_markdown_headers(F.col("chunk_text")).alias("result"))


@query(f"{U}, l as (select *, list_transform({_sql_lines('chunk_text')}, lambda l: {_sql_strip('l')}) as f from u) select chunk_id, {_sql_wraps('f')} as result from l")
def clean_line_wraps(spark, d):
    return _texts(spark, d).select("chunk_id", T.rejoin_wrapped_lines(F.col("chunk_text")).alias("result"))


@query(f"{U} select chunk_id, {_sql_noise('chunk_text')} as result from u")
def clean_noise_lines(spark, d):
    return _texts(spark, d).select("chunk_id", T.drop_noise_lines(F.col("chunk_text")).alias("result"))


@query(f"{U}{_CLEAN} select chunk_id, clean as result from cleaned")
def clean_full(spark, d):
    return _texts(spark, d).select("chunk_id", T.clean(F.col("chunk_text")).alias("result"))


@query(f"{U}{_CLEAN} select count(*) as texts, sum(length(coalesce(chunk_text, '')))::bigint as before, sum(length(clean))::bigint as after, sum(length(coalesce(chunk_text, '')) - length(clean))::bigint as removed from cleaned")
def cleaning_stats(spark, d):
    """A16."""
    n = _texts(spark, d).select(F.length(F.coalesce("chunk_text", F.lit(""))).cast("long").alias("a"), F.length(T.clean(F.col("chunk_text"))).cast("long").alias("b"))
    return n.agg(F.count("*").alias("texts"), F.sum("a").alias("before"), F.sum("b").alias("after"), F.sum(F.col("a") - F.col("b")).alias("removed"))


_COMMON = r".,;:!?()\[\]{}+\-=*/%$#@&''" + r'"“”‘’<>|\\'


@query(rf"""with t as (select doc_id, {_sql_strip('text')} as t from documents), r as (select *, list_filter(list_transform({_sql_lines('t')}, lambda l: {_sql_strip('l')}), lambda l: l <> '') as rows from t),
m as (select doc_id, length(t) as chars, case when length(t) > 0 then length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / length(t) end as letter, case when length(t) > 0 then length(regexp_replace(t, '[\p{{L}}\p{{N}} \t\n\r\x0b\x0c{_COMMON}]', '', 'g')) / length(t) end as odd,
case when length(t) > 0 then length(regexp_replace(t, '[^ \t\n\r\x0b\x0c]', '', 'g')) / length(t) end as space, len(rows) as lines, case when len(rows) > 0 then length(array_to_string(rows, '')) / len(rows) end as mean from r)
select doc_id, chars::int as chars, round(letter, 6) as letter_ratio, round(odd, 6) as odd_ratio, lines::int as lines, coalesce(chars >= 200 and letter >= 0.45 and odd <= 0.15 and lines >= 3, false) as passed, coalesce(space > 0.55, false) as warn_space, coalesce(mean < 15, false) as warn_short_lines from m""")
def quality_gate(spark, d):
    q = P.quality(F.col("text"))
    q |= {c: F.round(F.when(q["chars"] > 0, q[c]), 6) for c in ("letter_ratio", "odd_ratio")}
    return table(spark, d, "documents").select("doc_id", *[c.alias(k) for k, c in q.items()])


# blocks, headings, sentences

_BLOCKS = rf""", b as (select chunk_id, list_filter(list_transform(regexp_split_to_array({_sql_rstrip('chunk_text')}, '\n[ \t\n]*\n'), lambda x: {_sql_strip('x')}), lambda x: x <> '') as bs from u),
bl as (select chunk_id, unnest(range(0, len(bs)))::int as pos, unnest(bs) as block from b)"""
_HEADING = rf"""case when block = '' or contains(block, '<!--') then false when not regexp_matches(block, '{WS}') and ({_sql_weird('block')} or length(block) > 15) then false
when regexp_matches(block, '^#{{1,6}}[ \t\n]') then true when regexp_matches(block, '^([0-9]+[.)]|[-*])[ \t\n]') or length(block) > 75 or regexp_matches(block, '[.?!;:]\z') then false else true end"""
_NAME = rf"regexp_replace({_sql_strip(rf'''regexp_replace(block, '#{{1,6}}[ \t\n\r\x0b\x0c]', '', 'g')''')}, ' +', ' ', 'g')"


def _block_rows(spark, d):
    return _texts(spark, d).select("chunk_id", F.posexplode(T.blocks(F.col("chunk_text"))).alias("pos", "block"))


@query(f"{U}{_BLOCKS} select chunk_id, pos, block from bl")
def split_blocks(spark, d):
    """T9."""
    return _block_rows(spark, d)


@query(f"{U}{_BLOCKS} select chunk_id, pos, {_HEADING} as heading from bl")
def heading_flags(spark, d):
    """P15."""
    return _block_rows(spark, d).select("chunk_id", "pos", T.is_heading(F.col("block")).alias("heading"))


@query(f"{U}{_BLOCKS} select chunk_id, pos, {_NAME} as name from bl")
def heading_normalized(spark, d):
    """T21."""
    return _block_rows(spark, d).select("chunk_id", "pos", T.normalize_heading(F.col("block")).alias("name"))


@query(f"{U}{_BLOCKS}, h as (select chunk_id, pos, case when {_HEADING} then {_NAME} end as n from bl) select chunk_id, pos, coalesce(last_value(n ignore nulls) over (partition by chunk_id order by pos rows unbounded preceding), 'Unknown') as section from h")
def section_fill(spark, d):
    """J6, W7."""
    rows = _block_rows(spark, d).withColumns({"heading": T.is_heading(F.col("block")), "name": T.normalize_heading(F.col("block"))})
    return chunking.filled_sections(rows, "chunk_id", "pos", "heading", "name").select("chunk_id", "pos", "section")


_TB = rf"regexp_replace(regexp_replace({_sql_strip('block')}, '^#{{1,6}}{WS}+', ''), '{WS}+', ' ', 'g')"
_TBFLAG = rf"""(length({_sql_strip(f"regexp_replace(block, '{WS}+', ' ', 'g')")}) <= 140 and {_sql_strip(f"regexp_replace(block, '{WS}+', ' ', 'g')")} <> '' and (
regexp_matches({_sql_strip(f"regexp_replace(block, '{WS}+', ' ', 'g')")}, '^#{{1,6}} +[^ ]') or regexp_matches({_sql_strip(f"regexp_replace(block, '{WS}+', ' ', 'g')")}, '(?i)^(chapter|ch\.) +[0-9]+( +.+)?\z') or regexp_matches({_sql_strip(f"regexp_replace(block, '{WS}+', ' ', 'g')")}, '^[0-9]+(\.[0-9]+)*\.? +[A-Z][A-Za-z0-9,()\-:;? ]+\z')))"""


@query(f"{U}{_BLOCKS} select chunk_id, pos, {_TBFLAG} as heading, {_TB} as name, regexp_matches({_TB}, '(?i)^(chapter|ch\\.)[ \\t]+[0-9]+') as chapter from bl")
def textbook_headings(spark, d):
    """P16, P17, T22."""
    b = F.col("block")
    return _block_rows(spark, d).select("chunk_id", "pos", T.is_textbook_heading(b).alias("heading"), T.normalize_textbook_heading(b).alias("name"), T.is_chapter(T.normalize_textbook_heading(b)).alias("chapter"))


_SENT = rf"list_filter(list_transform(string_split(regexp_replace(text, '([.!?]){WS}+([A-Z])', '\1␞\2', 'g'), '␞'), lambda x: {_sql_strip('x')}), lambda x: x <> '')"
_SROWS = f"with s as (select doc_id, {_SENT} as s from documents), r as (select doc_id, unnest(range(0, len(s)))::int as pos, unnest(s) as sentence from s)"


@query(f"{_SROWS} select doc_id, pos, sentence from r")
def sentence_split(spark, d):
    """T17."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(r"select doc_id, case when length(text) <= 75 then text when contains(right(text, 75), ' ') then " + _sql_strip("substring(right(text, 75), instr(right(text, 75), ' '))") + " else right(text, 75) end as overlap from documents")
def char_overlap(spark, d):
    """T18."""
    return table(spark, d, "documents").select("doc_id", T.char_overlap(F.col("text"), 75).alias("overlap"))


_SUFFIX = "with s as (select doc_id, " + _SENT + " as s from documents), p as (select doc_id, s, list_reverse(s) as z from s), q as (select doc_id, s, list_transform(range(1, len(z) + 1), lambda i: list_sum(list_transform(z[1:i], lambda x: length(x)))) as c from p)"


@query(_SUFFIX + " select doc_id, array_to_string(s[len(s) - greatest(len(list_filter(c, lambda x: x <= 200)), 1) + 1:], ' ') as trailing from q where len(s) > 0")
def trailing_sentences(spark, d):
    """The last sentences that fit 200 characters, at least one."""
    return _suffix(spark, d, 1).withColumnRenamed("suffix", "trailing")


@query(_SUFFIX + " select doc_id, array_to_string(s[len(s) - len(list_filter(c, lambda x: x <= 75)) + 1:], ' ') as overlap from q where len(s) > 0")
def sentence_overlap(spark, d):
    """The last sentences that fit 75 characters, maybe none."""
    return _suffix(spark, d, 0, 75).withColumnRenamed("suffix", "overlap")


def _suffix(spark, d, least: int, budget: int = 200):
    from pyspark.sql import Window as W

    rows = table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    back = W.partitionBy("doc_id").orderBy(F.desc("pos"))
    rows = rows.withColumns({"sum": F.sum(F.length("s")).over(back.rowsBetween(W.unboundedPreceding, W.currentRow)), "n": F.row_number().over(back)})
    kept = F.transform(F.sort_array(F.collect_list(F.when((F.col("sum") <= budget) | (F.col("n") <= least), F.struct("pos", "s")))), lambda x: x.s)
    return rows.groupBy("doc_id").agg(F.array_join(kept, " ").alias("suffix"))


# chunking

_T, _O = 900, 75


@query(f"""with recursive s0 as (select doc_id, {_SENT} as s from documents), s1 as (select doc_id, s, list_transform(s, lambda x: length(x)) as l from s0 where len(s) > 0),
s2 as (select *, list_transform(range(0, len(l) + 1), lambda i: coalesce(list_sum(l[1:i]), 0)) as p from s1),
s3 as (select *, list_transform(range(1, len(l) + 1), lambda i: least(i, 1 + len(list_filter(range(0, i), lambda j: p[i + 1] - p[j + 1] > {_O}))) ) as o from s2),
f as (select doc_id, 1 as i, 0::bigint as st, 0::bigint as size, 0::bigint as a, 0::bigint as b from s1
union all
select f.doc_id, i + 1,
case when case when st = 0 then l[i] else size + 1 + l[i] end <= {_T} then case when st = 0 then i else st end when st > 0 then greatest(st, o[i - 1]) else 0 end,
case when case when st = 0 then l[i] else size + 1 + l[i] end <= {_T} then case when st = 0 then l[i] else size + 1 + l[i] end when st > 0 then p[i + 1] - p[greatest(st, o[i - 1])] + (i - greatest(st, o[i - 1])) else 0 end,
case when case when st = 0 then l[i] else size + 1 + l[i] end <= {_T} then 0 when st > 0 then st else i end,
case when case when st = 0 then l[i] else size + 1 + l[i] end <= {_T} then 0 when st > 0 then i - 1 else i end
from f join s3 using (doc_id) where i <= len(l)),
e as (select doc_id, a, b, i from f where a > 0 union all select f.doc_id, st, len(l), i from f join s1 using (doc_id) where i = len(l) + 1 and st > 0)
select doc_id, (row_number() over (partition by doc_id order by i, a, b) - 1)::int as piece, (a - 1)::int as first, (b - 1)::int as last, array_to_string(s[a:b], ' ') as piece_text from e join s1 using (doc_id)""")
def oversized_split(spark, d):
    """Every document as one oversized block."""
    docs = table(spark, d, "documents")
    ranges = chunking.oversized_ranges(docs, "doc_id", "text", _T, _O)
    texts = docs.select(F.col("doc_id").alias("document_id"), T.sentences(F.col("text")).alias("s"))
    cut = F.array_join(F.slice("s", F.col("first") + 1, F.col("last") - F.col("first") + 1), " ")
    return ranges.join(texts, "document_id").select(F.col("document_id").alias("doc_id"), "piece", "first", "last", cut.alias("piece_text"))


@query()
def chunk_generic(spark, d):
    """T24, T10."""
    return chunking.chunk_generic(table(spark, d, "documents"), "doc_id", "text", _T, _O)


_ITEMS = """items as (select distinct document_id, metadata.chunk_index as item_pos, metadata.page_start as page_no, case when metadata.chunk_index % 7 = 0 then 'section_header' when metadata.chunk_index % 7 = 3 then 'list_item' else 'text' end as label, case when metadata.chunk_index % 7 = 0 then metadata.section else chunk_text end as text from chunks)"""


def _items(spark, d):
    m = F.col("metadata")
    rows = _chunks(spark, d)
    label = F.when(m.chunk_index % 7 == 0, "section_header").when(m.chunk_index % 7 == 3, "list_item").otherwise("text")
    return rows.select("document_id", m.chunk_index.alias("item_pos"), m.page_start.alias("page_no"), label.alias("label"), F.when(m.chunk_index % 7 == 0, m.section).otherwise(F.col("chunk_text")).alias("text"))


_MARKDOWN = f"""{_ITEMS}, i2 as (select document_id, page_no, item_pos, {_sql_strip('text')} as t, label from items where page_no is not null), i3 as (select *, case when label = 'section_header' then chr(10) || '## ' || t || chr(10) when label = 'list_item' then '- ' || t else t end as line from i2 where t <> ''),
pg as (select document_id, page_no, {_sql_strip("string_agg(line, chr(10) || chr(10) order by item_pos)")} as body from i3 group by all),
md as (select document_id, string_agg('<PAGE ' || page_no || '>' || chr(10) || chr(10) || body, chr(10) || chr(10) order by page_no) as markdown from pg where body <> '' group by all)"""


@query(f"with {_MARKDOWN} select document_id, markdown from md")
def page_markdown(spark, d):
    """S8."""
    return pages.page_markdown(_items(spark, d))


@query(rf"""with {_MARKDOWN}, m2 as (select document_id, string_split(regexp_replace({_sql_strip('markdown')}, '(?i)(?:^|\n)\s*(?:<PAGE\s+(\d+)>|---\s*Page\s+(\d+)\s*---|<!--\s*page:\s*(\d+)\s*-->)\s*(?:\n|\z)', '␞\1\2\3␟', 'g'), '␞')[2:] as parts from md),
m3 as (select document_id, list_filter(list_transform(parts, lambda x: {{'page': string_split(x, '␟')[1]::int, 'text': {_sql_strip("string_split(x, '␟')[2]")}}}), lambda x: x.text <> '') as ps from m2)
select document_id, unnest(range(0, len(ps)))::int as pos, unnest(ps).page as page, unnest(ps).text as text from m3""")
def page_blocks(spark, d):
    """The pages of what page_markdown gives."""
    md = page_markdown(spark, d)
    return md.select("document_id", F.posexplode(chunking.page_array(F.col("markdown"))).alias("pos", "p")).select("document_id", "pos", "p.page", "p.text")


@query()
def textbook_units(spark, d):
    """T12, T20, W8 over the pages of page_markdown."""
    return chunking.textbook_units(page_markdown(spark, d), "document_id", "markdown")


@query()
def chunk_textbook(spark, d):
    """T25, T14."""
    return chunking.chunk_textbook(page_markdown(spark, d), "document_id", "markdown", _T, _O)


@query()
def chunk_dispatch(spark, d):
    """Every document by its own source type."""
    return chunking.chunk_documents(table(spark, d, "documents"), "doc_id", "text", "source", _T, _O)


# ids and paths


@query("select distinct record_id, 'doc_' || left(sha256(path), 12) as document_id from ingestion_manifest")
def document_ids(spark, d):
    """F2."""
    return table(spark, d, "ingestion_manifest").select("record_id", P.document_id(F.col("path")).alias("document_id")).distinct()


@query("select distinct chunk_id, 'chunk_' || left(sha256(concat_ws('|', document_id, chunk_text, metadata.chunk_index::varchar)), 12) as generic_id, 'chunk_' || left(sha1(concat_ws('_', document_id, metadata.chunk_index::varchar, chunk_text)), 12) as textbook_id from chunks")
def chunk_ids(spark, d):
    """F3, F4."""
    i = F.col("metadata.chunk_index")
    return table(spark, d, "chunks").select("chunk_id", P.generic_chunk_id(F.col("document_id"), F.col("chunk_text"), i).alias("generic_id"), P.textbook_chunk_id(F.col("document_id"), i, F.col("chunk_text")).alias("textbook_id")).distinct()


_PARTS = "list_filter(string_split(path, '/'), lambda x: x <> '' and x <> '.')"
_BELOW = "case when list_position({p}, 'raw') > 0 and list_position({p}, 'raw') + {n} < len({p}) then {p}[list_position({p}, 'raw') + {n}] end"


@query(rf"""select distinct record_id, regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*\z', '\1') as title, lower(regexp_extract(string_split(path, '/')[-1], '.(\.[^.]+)\z', 1)) as extension, {_BELOW.format(p=_PARTS, n=2)} as course, {_BELOW.format(p=_PARTS, n=1)} as raw_source from ingestion_manifest""")
def path_metadata(spark, d):
    """P1-P3, F7."""
    p = F.col("path")
    return table(spark, d, "ingestion_manifest").select("record_id", P.title(p).alias("title"), P.extension(p).alias("extension"), P.course(p).alias("course"), P.raw_source(p).alias("raw_source")).distinct()


_INGEST_CASE = "case " + " ".join(f"when k = '{a}' then '{b}'" for a, b in P.INGEST_ALIASES.items()) + " else coalesce(k, 'generic_text') end"
_CHUNK_CASE = "case " + " ".join(f"when k in ({', '.join(repr(x) for x in xs)}) then '{n}'" for n, xs in P.CHUNK_ALIASES.items()) + " else 'generic_text' end"


@query(f"with t as (select record_id, lower({_sql_strip('raw_source_type')}) as k from ingestion_manifest) select distinct record_id, {_INGEST_CASE} as source_type from t")
def source_type_ingest(spark, d):
    """P4a."""
    return table(spark, d, "ingestion_manifest").select("record_id", P.ingest_source_type(F.col("raw_source_type")).alias("source_type")).distinct()


@query(f"with t as (select record_id, {_sql_strip('lower(raw_source_type)')} as k from ingestion_manifest) select distinct record_id, {_CHUNK_CASE} as source_type from t")
def source_type_chunk(spark, d):
    """P4b."""
    return table(spark, d, "ingestion_manifest").select("record_id", P.chunk_source_type(F.col("raw_source_type")).alias("source_type")).distinct()


def _sql_week(path: str) -> str:
    first = rf"list_filter(list_transform(string_split({path}, '/'), lambda x: replace(lower({_sql_strip('x')}), '-', '_')), lambda x: regexp_matches(x, '^week_?[0-9]+\z'))[1]"
    return f"case when {first} is not null then 'week_' || printf('%02d', regexp_extract({first}, '[0-9]+')::int) end"


@query(f"select distinct record_id, {_sql_week('path')} as week from ingestion_manifest")
def infer_week(spark, d):
    """F8."""
    return table(spark, d, "ingestion_manifest").select("record_id", P.week(F.col("path")).alias("week")).distinct()


# manifest and store


@query("select distinct record_id from ingestion_manifest f where batch_no > 0 and not exists (select 1 from ingestion_manifest m where m.batch_no = 0 and m.status = 'success' and m.path = f.path and m.file_hash = f.file_hash)")
def manifest_changed(spark, d):
    """The deliveries of later batches that history doesn't have unchanged."""
    m = table(spark, d, "ingestion_manifest")
    return manifest.changed_files(m.where("batch_no > 0").select("record_id", "path", "file_hash"), m.where("batch_no = 0")).select("record_id").distinct()


@query("""with r as (select distinct record_id, batch_no, path, status, file_hash from ingestion_manifest), k as (select *, row_number() over (partition by path order by (batch_no > 0)::int desc, batch_no desc, record_id desc) as n from r where batch_no = 0 or status is distinct from 'skipped')
select path, record_id, status, file_hash from k where n = 1""")
def manifest_upsert(spark, d):
    """U8: later batches into the manifest of history."""
    m = table(spark, d, "ingestion_manifest").select("record_id", "batch_no", "path", "status", "file_hash").distinct()
    return manifest.upserted(m.where("batch_no = 0"), m.where("batch_no > 0"), ["batch_no", "record_id"]).select("path", "record_id", "status", "file_hash")


@query("with r as (select distinct record_id, batch_no, status, chunks_created from ingestion_manifest) select batch_no, count(*) as records, count(*) filter (status = 'success') as succeeded, count(*) filter (status = 'skipped') as skipped, count(*) filter (status = 'failed') as failed, coalesce(sum(chunks_created) filter (status = 'success'), 0)::bigint as chunks from r group by batch_no")
def batch_summary(spark, d):
    """A5."""
    m = table(spark, d, "ingestion_manifest").select("record_id", "batch_no", "status", "chunks_created").distinct()
    return manifest.batch_summary(m, ["batch_no"])


@query(f"{U} select chunk_id from u where regexp_replace(chunk_text, '{WS}', '', 'g') <> ''")
def embed_validate(spark, d):
    """P7."""
    return embedding.valid_chunks(_texts(spark, d), "chunk_text").select("chunk_id")


@query(f"{UM} select distinct chunk_id, coalesce(metadata.course, '') as course, coalesce(metadata.section, '') as section, coalesce(metadata.chapter, '') as chapter from u where chunk_id is not null and chunk_text is not null and chunk_text <> '' and metadata.unit_count is not null")
def vector_validate(spark, d):
    """P8, with a stand-in vector that only chunks of counted units have."""
    rows = _chunks(spark, d).select("chunk_id", "chunk_text", F.when(F.col("chunk_text") == "", None).when(F.col("metadata.unit_count").isNotNull(), F.array(F.lit(1.0))).alias("v"), "metadata.course", "metadata.section", "metadata.chapter")
    return embedding.valid_vectors(rows, "chunk_id", "chunk_text", "v", ["course", "section", "chapter"]).select("chunk_id", "course", "section", "chapter")


_FAILED = "(select document_id from ingestion_manifest where lower(status) = 'failed' and document_id is not null)"


@query(f"select distinct chunk_id from chunks where document_id not in {_FAILED}")
def delete_document(spark, d):
    """Without the chunks of documents of which some delivery failed."""
    gone = table(spark, d, "ingestion_manifest").where("lower(status) = 'failed' and document_id is not null")
    return store.deleted(_chunks(spark, d).select("chunk_id", "document_id"), gone, "document_id").select("chunk_id")


@query(f"select distinct chunk_id, 0 as version from chunks where document_id not in {_FAILED} union all select distinct chunk_id || '_new', 1 from chunks where document_id in {_FAILED}")
def replace_document(spark, d):
    """The chunks of those documents are replaced by new versions."""
    rows = _chunks(spark, d).select("chunk_id", "document_id", F.lit(0).alias("version"))
    again = table(spark, d, "ingestion_manifest").where("lower(status) = 'failed' and document_id is not null").select("document_id").distinct()
    new = rows.join(again, "document_id", "left_semi").select(F.concat("chunk_id", F.lit("_new")).alias("chunk_id"), "document_id", F.lit(1).alias("version"))
    return store.replaced(rows, new, "document_id").select("chunk_id", "version")


# retrieval

_DENSE = """q as (select vec_id as query_id, embedding::double[] as qv from embeddings where vec_id % 20 = 0), dist as (select query_id, vec_id as id, round(list_sum(list_transform(range(1, 65), lambda i: (qv[i] - (embedding::double[])[i]) ** 2)), 6) as distance from q, embeddings),
ranked as (select *, row_number() over (partition by query_id order by distance, id) as rank from dist)"""


def _dense(spark, d, k):
    e = table(spark, d, "embeddings")
    return dense.topk(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", "vec_id", "embedding", k)


@query(f"with {_DENSE} select query_id, id, distance, rank::int as rank, round(1 / (1 + distance), 6) as similarity from ranked where rank <= 8")
def dense_topk(spark, d):
    """Every vector whose id is divisible by 20 against all vectors."""
    return _dense(spark, d, 8)


@query(f"with {_DENSE}, f as (select r.query_id, r.id, row_number() over (partition by r.query_id order by r.rank) as rank from ranked r join embeddings e on e.vec_id = r.id where r.rank <= 40 and e.label = r.query_id % 10) select query_id, id, rank::int as rank from f where rank <= 8")
def dense_filtered_overfetch(spark, d):
    """Five times as many are fetched, then filtered."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return dense.topk_per_course(_dense(spark, d, 40).join(e, "id"), F.col("label") == F.col("query_id") % 10, 8).select("query_id", "id", "rank")


@query()
def dense_index_topk(spark, d):
    """The same through the inverted-file index; a test measures its recall."""
    e = table(spark, d, "embeddings")
    return dense.CellIndex(e, "vec_id", "embedding").topk(e.where("vec_id % 20 = 0"), "vec_id", "embedding", 8)


_STOP = ", ".join(f"'{w}'" for w in lexical.STOP_WORDS)
_TOK = "list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t not in (" + _STOP + "))"
_BM25 = f"""c as (select distinct chunk_id as id, {_TOK.format(x="coalesce(chunk_text, '')")} as t from chunks WHEREC), st as (select count(*) as n, avg(len(t)) as avgdl from c),
tf as (select id, len(t) as dl, unnest(t) as term from c), tfc as (select id, dl, term, count(*) as tf from tf group by all), df as (select term, count(*) as df from tfc group by all),
qt as (select id as query_id, unnest({_TOK.format(x="query")}) as term from queries), qc as (select query_id, term, count(*) as times from qt group by all),
sc as (select query_id, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score from qc join tfc using (term) join df using (term), st group by all),
full_ as (select q.id as query_id, c.id, coalesce(score, 0) as score from queries q cross join c left join sc on sc.query_id = q.id and sc.id = c.id), bm as (select *, row_number() over (partition by query_id order by score desc, id) as rank from full_)"""


def _queries(spark, d):
    return table(spark, d, "queries").select(F.col("id").alias("query_id"), "query")


@query("with c as (select distinct chunk_id, " + _TOK.format(x="coalesce(chunk_text, '')") + " as t from chunks) select count(*) as n, round(avg(len(t)), 6) as avgdl from c")
def bm25_stats(spark, d):
    """A6."""
    return lexical.corpus_stats(_texts(spark, d), "chunk_id", "chunk_text").select("n", F.round("avgdl", 6).alias("avgdl"))


@query("with c as (select distinct chunk_id, " + _TOK.format(x="coalesce(chunk_text, '')") + " as t from chunks), w as (select chunk_id, unnest(t) as term from c), p as (select chunk_id, term, count(*) as tf from w group by all) select term, count(*) as df, sum(tf)::bigint as cf from p group by term")
def bm25_terms(spark, d):
    """Document and collection frequency of every term of the index."""
    return lexical.postings(_texts(spark, d), "chunk_id", "chunk_text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"with {_BM25.replace('WHEREC', '')} select query_id, id, score, rank::int as rank from bm where rank <= 8")
def bm25_topk(spark, d):
    """R3, O2."""
    return lexical.topk(_queries(spark, d), table(spark, d, "chunks"), "query_id", "query", "chunk_id", "chunk_text", 8).select("query_id", "id", "score", "rank")


@query(f"with {_BM25.replace('WHEREC', chr(10) + ' where lower(metadata.course) = ' + chr(39) + 'stx210' + chr(39))} select query_id, id, score, rank::int as rank from bm where rank <= 8")
def bm25_filtered(spark, d):
    """R2: the corpus is filtered first, so its statistics are those of the course."""
    course = listing.matching(table(spark, d, "chunks"), course="stx210")
    return lexical.topk(_queries(spark, d), course, "query_id", "query", "chunk_id", "chunk_text", 8).select("query_id", "id", "score", "rank")


@query(ORACLES["bm25_topk"])
def bm25_index_topk(spark, d):
    """The same through an index that is saved, found stale or fresh, and opened again."""
    import uuid

    from ..operators.lexical_index import LexicalIndex
    from ..session import shared_dir

    index = LexicalIndex(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    index.ensure(_texts(spark, d), "chunk_id", "chunk_text", "all")
    return index.search(_queries(spark, d), "query_id", "query", 8).select("query_id", "id", "score", "rank")


_R = "r as (select distinct run_id, query_id, pipeline, result_rank, chunk_id, dense_score_norm, bm25_score_norm, hybrid_score from retrieval_results)"


def _results(spark, d):
    return table(spark, d, "retrieval_results").select("run_id", "query_id", "pipeline", "result_rank", "chunk_id", "dense_score_norm", "bm25_score_norm", "hybrid_score").distinct()


@query(f"""with {_R}, w as (select *, min(dense_score_norm) over p as lo, max(dense_score_norm) over p as hi from r window p as (partition by run_id, query_id, pipeline))
select run_id, query_id, pipeline, result_rank, chunk_id, round(case when hi is null then 0 when lo = hi then 1 when dense_score_norm is null then 0 else (dense_score_norm - lo) / (hi - lo) end, 6) as norm from w""")
def score_normalize(spark, d):
    """R4, A7, W6."""
    keys = ["run_id", "query_id", "pipeline"]
    return _results(spark, d).select(*keys, "result_rank", "chunk_id", F.round(hybrid.normalized(F.col("dense_score_norm"), keys), 6).alias("norm"))


_MERGED = f"""{_R}, dn as (select run_id, query_id, chunk_id, min(result_rank) as dense_rank, max(dense_score_norm) as dense_norm from r where pipeline = 'dense' group by all), bm as (select run_id, query_id, chunk_id, min(result_rank) as bm25_rank, max(bm25_score_norm) as bm25_norm from r where pipeline = 'hybrid' group by all),
mg as (select run_id, query_id, chunk_id, dense_rank, bm25_rank, coalesce(dense_norm, 0) as dense_norm, coalesce(bm25_norm, 0) as bm25_norm from dn full join bm using (run_id, query_id, chunk_id) where run_id is not null and query_id is not null and chunk_id is not null)"""


def _merged(spark, d):
    r = _results(spark, d)
    keys = ["run_id", "query_id", "chunk_id"]
    one = r.where("pipeline = 'dense'").groupBy(*keys).agg(F.min("result_rank").alias("dense_rank"), F.max("dense_score_norm").alias("dense_norm"))
    two = r.where("pipeline = 'hybrid'").groupBy(*keys).agg(F.min("result_rank").alias("bm25_rank"), F.max("bm25_score_norm").alias("bm25_norm"))
    return hybrid.merge(one, two, keys)


@query(f"with {_MERGED} select run_id, query_id, chunk_id, dense_rank, bm25_rank, round(dense_norm, 6) as dense_norm, round(bm25_norm, 6) as bm25_norm from mg")
def hybrid_merge(spark, d):
    """J1, U2."""
    return _merged(spark, d).select("run_id", "query_id", "chunk_id", "dense_rank", "bm25_rank", F.round("dense_norm", 6).alias("dense_norm"), F.round("bm25_norm", 6).alias("bm25_norm"))


_PRACTICE = "(" + " or ".join(f"contains(lower(coalesce(query, '')), '{t}')" for t in S.PRACTICE_TERMS) + ")"
_PENALTY = f"case when {_PRACTICE} then 1.0::double when " + " or ".join(f"contains(lower(coalesce(section, '')), '{t}')" for t in S.EXERCISE_PARTS) + " then 0.25::double when contains(lower(coalesce(section, '')), 'lab') then 0.85::double else 1.0::double end"
_SNAME = f"regexp_replace(lower({_sql_strip(chr(99) + 'oalesce(section, ' + chr(39) * 2 + ')')}), '{WS}+', ' ', 'g')"
_EXERCISE = f"({_SNAME} in ({', '.join(repr(x) for x in S.EXERCISE_NAMES)}) or starts_with({_SNAME}, 'exercises') or ends_with({_SNAME}, 'exercises'))"


def _details(spark, d):
    return _chunks(spark, d).select("chunk_id", "metadata.section")


@query(f"""with {_MERGED}, x as (select mg.*, section, query from mg join (select distinct chunk_id, metadata.section as section from chunks) using (chunk_id) join queries on queries.id = query_id),
y as (select run_id, query_id, chunk_id, dense_rank, bm25_rank, round(0.6 * dense_norm + 0.4 * bm25_norm, 6) as raw, {_PENALTY} as penalty from x), z as (select *, round(raw * penalty, 6) as hybrid_score from y)
select run_id, query_id, chunk_id, raw, penalty, hybrid_score, row_number() over (partition by run_id, query_id order by hybrid_score desc, dense_rank nulls last, bm25_rank nulls last, chunk_id)::int as rank from z""")
def hybrid_score(spark, d):
    """R5, F12, W3."""
    rows = _merged(spark, d).join(_details(spark, d), "chunk_id").join(F.broadcast(_queries(spark, d)), "query_id")
    rows = rows.withColumns({"q": F.col("query_id"), "query_id": F.struct("run_id", "query_id"), "id": F.col("chunk_id")})
    out = hybrid.fused(rows, "query", "section", 0.6)
    return out.select("run_id", F.col("q").alias("query_id"), "chunk_id", "raw", "penalty", "hybrid_score", "rank")


@query(f"""with {_R}, x as (select r.*, section, query from r join (select distinct chunk_id, metadata.section as section from chunks) using (chunk_id) join queries on queries.id = query_id where pipeline = 'hybrid'),
y as (select *, {_EXERCISE} as ex, {_PRACTICE} as pr, count(*) filter (not {_EXERCISE}) over (partition by run_id, query_id) as left_ from x) select run_id, query_id, result_rank, chunk_id from y where pr or not ex or left_ < 1""")
def exercise_filter(spark, d):
    """P13, P14."""
    rows = _results(spark, d).where("pipeline = 'hybrid'").join(_details(spark, d), "chunk_id").join(F.broadcast(_queries(spark, d)), "query_id")
    return hybrid.exercise_filtered(rows, "query", "section", 1, ["run_id", "query_id"]).select("run_id", "query_id", "result_rank", "chunk_id")


@query(f"with s as (select distinct metadata.section as section from chunks) select id as query_id, section, {_PRACTICE} as practice, {_PENALTY} as penalty, {_EXERCISE} as exercise from queries, s")
def section_penalty(spark, d):
    """P12, P13, F11, F12 for every query and section name."""
    sections = table(spark, d, "chunks").select("metadata.section").distinct()
    q = F.broadcast(_queries(spark, d))  # the sixty queries against every section name is what is asked for here
    return sections.crossJoin(q).select("query_id", "section", S.is_practice(F.col("query")).alias("practice"), S.section_penalty(F.col("section"), F.col("query")).alias("penalty"), S.is_exercise(F.col("section")).alias("exercise"))


_K, _ALPHA = 8, 0.6
_HASHED = f"""hb as (select id, ('0x' || left(md5(term), 7))::bigint % 64 as b from (select id, unnest(t) as term from c)), hv as (select id, b, count(*)::double as n from hb group by all), hn as (select id, sqrt(sum(n * n)) as norm from hv group by all),
qt2 as (select id as query_id, unnest({_TOK.format(x="query")}) as term from queries), qb as (select query_id, ('0x' || left(md5(term), 7))::bigint % 64 as b, count(*)::double as n from qt2 group by all), qn as (select query_id, sqrt(sum(n * n)) as norm from qb group by all),
dots as (select query_id, hv.id, sum(qb.n / qn.norm * hv.n / hn.norm) as dot from qb join qn using (query_id) join hv using (b) join hn on hn.id = hv.id group by all),
dd as (select qn.query_id, hn.id, round(2 - 2 * coalesce(dot, 0), 6) as distance from qn cross join hn left join dots on dots.query_id = qn.query_id and dots.id = hn.id), dr as (select query_id, id, distance, round(1 / (1 + distance), 6) as similarity, row_number() over (partition by query_id order by distance, id) as rank from dd),
dt as (select query_id, id, rank as dense_rank, similarity as dense_similarity from dr where rank <= {_K}), bt as (select query_id, id, rank as bm25_rank, score as bm25_score from bm where rank <= {_K}),
dnm as (select *, round(case when max(dense_similarity) over p is null then 0 when max(dense_similarity) over p = min(dense_similarity) over p then 1 when dense_similarity is null then 0 else (dense_similarity - min(dense_similarity) over p) / (max(dense_similarity) over p - min(dense_similarity) over p) end, 6) as dense_norm from dt window p as (partition by query_id)),
bnm as (select *, round(case when max(bm25_score) over p is null then 0 when max(bm25_score) over p = min(bm25_score) over p then 1 when bm25_score is null then 0 else (bm25_score - min(bm25_score) over p) / (max(bm25_score) over p - min(bm25_score) over p) end, 6) as bm25_norm from bt window p as (partition by query_id)),
hm as (select query_id, id, dense_rank, dense_similarity, bm25_rank, bm25_score, coalesce(dense_norm, 0) as dense_norm, coalesce(bm25_norm, 0) as bm25_norm from dnm full join bnm using (query_id, id)),
hx as (select hm.*, section, query, chunk_text, m from hm join (select distinct chunk_id as id, metadata.section as section, chunk_text, metadata as m from chunks) using (id) join queries on queries.id = hm.query_id),
hy as (select *, round({_ALPHA} * dense_norm + {1 - _ALPHA} * bm25_norm, 6) as raw, {_PENALTY} as penalty, {_EXERCISE} as ex, {_PRACTICE} as pr from hx), hz as (select *, round(raw * penalty, 6) as hybrid_score from hy),
hr as (select *, row_number() over (partition by query_id order by hybrid_score desc, dense_rank nulls last, bm25_rank nulls last, id) as rank, count(*) filter (not ex) over (partition by query_id) as left_ from hz),
hf as (select *, row_number() over (partition by query_id order by rank) as place from hr where pr or not ex or left_ < 1), hy_top as (select * from hf where place <= {_K})"""


def _hybrid(spark, d, k=_K, top=_K):
    from .search import retrieve

    chunks = table(spark, d, "chunks")
    return hybrid.first(retrieve(_queries(spark, d), chunks, chunks, k, _ALPHA), top)


@query(f"with {_BM25.replace('WHEREC', '')}, {_HASHED} select query_id, id, rank::int as rank, hybrid_score, raw, penalty, dense_rank::int as dense_rank, bm25_rank::int as bm25_rank from hy_top")
def hybrid_topk(spark, d):
    """Every query against all chunks."""
    return _hybrid(spark, d).select("query_id", "id", "rank", "hybrid_score", "raw", "penalty", "dense_rank", "bm25_rank")


_SHARE = f"case when len(list_distinct({_TOK.format(x='query')})) > 0 then len(list_intersect(list_distinct({_TOK.format(x='query')}), {_TOK.format(x=chr(99) + 'oalesce(chunk_text, ' + chr(39) * 2 + ')')})) / len(list_distinct({_TOK.format(x='query')})) else 0 end"
_RERANK = f"rs as (select *, round({_SHARE}, 6) as rerank_score from hy_top), rr as (select *, row_number() over (partition by query_id order by rerank_score desc, rank) as new_rank from rs)"


def _reranked(spark, d, k):
    rows = _hybrid(spark, d).withColumn("similarity", F.col("dense_similarity"))
    return hybrid.rerank(rows, "query", F.col("chunk_text"), k)


@query(f"with {_BM25.replace('WHEREC', '')}, {_HASHED}, {_RERANK} select query_id, id, new_rank::int as rank, rank::int as dense_rank, rerank_score from rr where new_rank <= 3")
def rerank_topk(spark, d):
    """R9, R10, W4, O4."""
    return _reranked(spark, d, 3).select("query_id", "id", "rank", "dense_rank", "rerank_score")


_PAGES = "case when ({a} is null) and ({b} is null) then 'unknown' when {a} is not distinct from {b} then {a}::varchar else coalesce({a}::varchar, 'None') || '-' || coalesce({b}::varchar, 'None') end"
_PG = _PAGES.format(a="m.page_start", b="m.page_end")
_SPAGE = "case when m.page_start is null and m.page_end is null then null when m.page_end is null or m.page_start = m.page_end then m.page_start::varchar else " + _PG + " end"


@query(f"with {_BM25.replace('WHEREC', '')}, {_HASHED}, {_RERANK} select query_id, new_rank::int as rank, id as chunk_id, chunk_text, coalesce(m.file_name, m.title) as source, m.file_path as source_path, m.source_type as source_type, m.course as course, {_sql_week('m.file_path')} as week, m.section as section, {_SPAGE} as page, rerank_score as score from rr where new_rank <= 5")
def search_notes(spark, d):
    """The search service over every query, without filters."""
    from .search import search

    return search(_queries(spark, d), table(spark, d, "chunks"), top_k=5, candidates=_K, alpha=_ALPHA)


@query()
def search_notes_filtered(spark, d):
    """R11 within a course and a week."""
    from .search import search

    return search(_queries(spark, d), table(spark, d, "chunks"), course="STX210", week=None, top_k=5, alpha=_ALPHA)


# listings


@query(f"""with u as (select distinct chunk_id, metadata as m from chunks), s as (select chunk_id, m, coalesce(nullif(m.document_id, ''), nullif(m.file_path, ''), nullif(m.file_name, ''), nullif(m.title, ''), 'unknown_source') as source_id from u),
r as (select *, row_number() over (partition by source_id order by m.chunk_index, chunk_id) as n, count(*) over (partition by source_id) as chunk_count from s)
select source_id, m.title as title, m.course as course, {_sql_week('m.file_path')} as week, m.source_type as source_type, m.file_path as source_path, m.file_name as file_name, chunk_count from r where n = 1""")
def list_documents(spark, d):
    """A1."""
    return listing.documents(_chunks(spark, d))


@query(f"with u as (select distinct chunk_id, metadata as m from chunks) select count(*) as chunk_count, count(distinct m.document_id) as source_count, array_to_string(list_sort(list(distinct m.course) filter (m.course <> '')), ',') as courses, array_to_string(list_sort(list(distinct {_sql_week('m.file_path')}) filter ({_sql_week('m.file_path')} is not null)), ',') as weeks from u")
def collection_stats(spark, d):
    """A4."""
    return listing.stats(_chunks(spark, d)).withColumns({c: F.array_join(c, ",") for c in ("courses", "weeks")})


@query(f"with u as (select distinct chunk_id, metadata as m from chunks) select chunk_id, {_PG} as pages, {_SPAGE} as page from u")
def page_range(spark, d):
    """F14, F15."""
    a, b = F.col("metadata.page_start"), F.col("metadata.page_end")
    return _chunks(spark, d).select("chunk_id", S.page_range(a, b).alias("pages"), S.search_page(a, b).alias("page"))


@query(f"with {_R} select run_id, query_id, pipeline, result_rank, chunk_id, round(try_cast(coalesce(case when result_rank = 2 then 'n/a' end, hybrid_score::varchar, dense_score_norm::varchar, bm25_score_norm::varchar) as double), 6) as score from r")
def score_precedence(spark, d):
    """the first score decides, even if it is no number."""
    s = S.first_score(F.when(F.col("result_rank") == 2, "n/a"), F.col("hybrid_score").cast("string"), F.col("dense_score_norm").cast("string"), F.col("bm25_score_norm").cast("string"))
    return _results(spark, d).select("run_id", "query_id", "pipeline", "result_rank", "chunk_id", F.round(s, 6).alias("score"))


# answers and evaluation

_LIST = "l as (select concat_ws('/', run_id, query_id, pipeline) as list, result_rank as rank, r.chunk_id, chunk_text, m from r join (select distinct chunk_id, chunk_text, metadata as m from chunks) c using (chunk_id))"


def _lists(spark, d):
    return _results(spark, d).join(_chunks(spark, d).drop("document_id"), "chunk_id").select(F.concat_ws("/", "run_id", "query_id", "pipeline").alias("list"), F.col("result_rank").alias("rank"), "chunk_id", "chunk_text", "metadata")


_HEAD = "'Rank: ' || rank || chr(10) || 'File: ' || coalesce(m.file_name, 'unknown file') || chr(10) || 'Title: ' || coalesce(m.title, 'unknown title') || chr(10) || 'Course: ' || coalesce(m.course, 'unknown course') || chr(10) || 'Source Type: ' || coalesce(m.source_type, 'unknown source type') || chr(10) || 'Chapter: ' || coalesce(m.chapter, 'unknown chapter') || chr(10) || 'Section: ' || coalesce(m.section, 'unknown section') || chr(10) || 'Pages: ' || " + _PG + " || chr(10) || 'Chunk ID: ' || chunk_id || chr(10) || 'Citation: ' || coalesce(m.file_name, 'unknown file') || ', ' || coalesce(m.section, 'unknown section') || ', pages ' || " + _PG


@query(f"with {_R}, {_LIST}, n as (select list, row_number() over (partition by list order by rank, chunk_id) as i, {_HEAD} || chr(10) || chr(10) || 'Text:' || chr(10) || coalesce(chunk_text, '') as body from l), b as (select list, i, {_sql_strip(chr(39) + '[Context Block ' + chr(39) + ' || i || ' + chr(39) + ']' + chr(39) + ' || chr(10) || body')} as body from n) select list, string_agg(body, chr(10) || chr(10) || repeat('-', 80) || chr(10) || chr(10) order by i) as context from b group by list")
def context_block(spark, d):
    """G2, A14."""
    return answers.context_blocks(_lists(spark, d), "list")


_CITE = "'- ' || coalesce(m.file_name, 'unknown file') || ', ' || coalesce(m.section, 'unknown section') || ', pages ' || " + _PG


@query(f"with {_R}, {_LIST}, n as (select list, row_number() over (partition by list order by rank, chunk_id) as i, {_CITE} as line from l), f as (select list, line, min(i) as i from n where i <= 3 group by all) select list, string_agg(line, chr(10) order by i) as sources from f group by list")
def citations(spark, d):
    """G6, U4."""
    return answers.citations(_lists(spark, d), "list")


_ANSWER = "text || case when doc_id % 3 = 0 then chr(10) || 'Sources:' || chr(10) || '- a' when doc_id % 3 = 1 then chr(10) || 'Source: b' || chr(10) || 'Sources:' else '' end"
_CUT = "case when contains({x}, chr(10) || '{m}') then " + _sql_strip("string_split({x}, chr(10) || '{m}')[1]") + " else {x} end"


@query("with t as (select doc_id, " + _ANSWER + " as a from documents), s as (select doc_id, " + _CUT.replace("{x}", "a").replace("{m}", "Sources:") + " as b from t) select doc_id, " + _CUT.replace("{x}", "b").replace("{m}", "Source:") + " as answer from s")
def strip_sources(spark, d):
    """F24."""
    extra = F.when(F.col("doc_id") % 3 == 0, "\nSources:\n- a").when(F.col("doc_id") % 3 == 1, "\nSource: b\nSources:").otherwise("")
    return table(spark, d, "documents").select("doc_id", S.strip_sources(F.concat("text", extra)).alias("answer"))


@query()
def generate_answers(spark, d):
    """G3-G5 with the offline model over the hybrid results of every query."""
    rows = _hybrid(spark, d).withColumn("chunk_id", F.col("id"))
    return answers.answers(_queries(spark, d), rows, "query_id", "query")


_EV = f"""{_R}, t as (select run_id, query_id, pipeline, string_agg(coalesce(chunk_text, ''), ' ' order by result_rank, r.chunk_id) as text from r left join (select distinct chunk_id, chunk_text from chunks) c using (chunk_id) where result_rank <= 3 group by all),
ks as (select run_id, query_id, pipeline, case when len(expected_keywords) > 0 then len(list_filter(expected_keywords, lambda k: contains(lower(text), lower(k)))) / len(expected_keywords) else 0 end as retrieval_score from t join queries on queries.id = query_id)"""


def _scores(spark, d):
    q = F.broadcast(table(spark, d, "queries").select(F.col("id").alias("query_id"), F.col("expected_keywords").alias("keywords")))
    return evaluation.query_scores(_results(spark, d), _texts(spark, d), q, ["run_id", "query_id", "pipeline"])


@query(f"with {_EV} select run_id, query_id, pipeline, round(retrieval_score, 6) as retrieval_score from ks")
def keyword_score(spark, d):
    """F16, F17."""
    return _scores(spark, d).withColumn("retrieval_score", F.round("retrieval_score", 6))


_GRID = "grid as (select g as grp, p as pipeline from (values ('all'), ('semantic'), ('lexical')) a(g), (values ('dense'), ('dense_reranker'), ('hybrid'), ('hybrid_reranker')) b(p))"


@query(f"""with {_EV}, s as (select *, case when starts_with(query_id, 'lexical_') then 'lexical' else 'semantic' end as grp from ks), a as (select coalesce(grp, 'all') as grp, pipeline, count(*) as queries, avg(retrieval_score) as mean from s group by grouping sets ((pipeline), (grp, pipeline))),
{_GRID}, f as (select grid.grp, grid.pipeline, coalesce(queries, 0) as queries, mean from grid left join a using (grp, pipeline)) select f.grp, f.pipeline, f.queries, round(f.mean, 6) as mean, case when f.pipeline <> 'dense' then round(f.mean - e.mean, 6) end as delta from f join f e on e.grp = f.grp and e.pipeline = 'dense'""")
def eval_summary(spark, d):
    """V7, A10-A12."""
    return evaluation.summary(_scores(spark, d))


@query(f"""with {_R}, t as (select run_id, query_id, pipeline, arg_min(chunk_id, {{'r': result_rank, 'c': chunk_id}}) as top from r group by all) select t.pipeline, count(*) as lists, count(*) filter (t.top is distinct from x.top) as changed from t join t x on x.run_id = t.run_id and x.query_id = t.query_id and x.pipeline = 'dense' and x.top is not null where t.pipeline <> 'dense' group by t.pipeline""")
def top_changes(spark, d):
    """V9, J8, W12."""
    return evaluation.top_changes(_results(spark, d), ["run_id", "query_id"])


@query("with r as (select distinct run_id, query_id, pipeline, result_rank, chunk_id, retrieved_at, logged_at from retrieval_results) select pipeline, count(s) as n, round(sum(s), 3) as total_s, round(avg(s), 6) as mean_s from (select pipeline, (epoch_us(logged_at) - epoch_us(retrieved_at)) / 1000000.0::double as s from r) group by pipeline")
def timing_rollup(spark, d):
    """A13."""
    r = table(spark, d, "retrieval_results").select("run_id", "query_id", "pipeline", "result_rank", "chunk_id", "retrieved_at", "logged_at").distinct()
    return evaluation.timing_rollup(r.withColumn("s", (F.unix_micros("logged_at") - F.unix_micros("retrieved_at")) / 1e6), "pipeline", "s")


@query(f"with {_EV}, m as (select pipeline, round(avg(retrieval_score), 6) as mean from ks group by all) select arg_max(pipeline, {{'m': mean, 'o': -case pipeline when 'dense' then 0 when 'dense_reranker' then 1 when 'hybrid' then 2 else 3 end}}) as winner, max(mean) as mean from m")
def ab_winner(spark, d):
    """The pipeline with the best mean."""
    order = F.array_position(F.array(*[F.lit(p) for p in S.PIPELINES]), F.col("pipeline"))
    return evaluation.winner(_scores(spark, d), "pipeline", "retrieval_score", order)


@query(f"select distinct title, nullif(regexp_replace(regexp_replace(lower({_sql_strip('title')}), '[^a-z0-9]+', '-', 'g'), '^-+|-+\\z', '', 'g'), '') as slug, left(title, 12) as preview from documents")
def slug(spark, d):
    """F20, F23."""
    return table(spark, d, "documents").select("title", S.slug(F.col("title")).alias("slug"), T.preview(F.col("title"), 12).alias("preview")).distinct()


@query("""with f as (select distinct path, file_hash, file_size from ingestion_manifest where batch_no = 0), l as (select sha256(concat_ws('|', path, coalesce(file_hash, ''), file_size::varchar)) as d from f),
p as (select ('0x' || left(d, 4))::int % 1024 as bucket, ('0x' || d[1:13])::bigint as p0, ('0x' || d[14:26])::bigint as p1, ('0x' || d[27:39])::bigint as p2, ('0x' || d[40:52])::bigint as p3 from l), s as (select bucket, count(*) as n, sum(p0) as p0, sum(p1) as p1, sum(p2) as p2, sum(p3) as p3 from p group by bucket)
select coalesce(sum(n), 0)::bigint as files, sha256(string_agg(concat_ws('|', bucket, n, p0, p1, p2, p3), chr(10) order by bucket)) as fingerprint from s""")
def fingerprint(spark, d):
    """One value that changes with any file of history."""
    from ..sources.files import fingerprint as of

    return of(table(spark, d, "ingestion_manifest").where("batch_no = 0").select("path", "file_hash", "file_size").distinct())


@query()
def embed_chunks(spark, d):
    """G0, P9, P22."""
    return embedding.embed(_texts(spark, d), "chunk_text").select("chunk_id", "embedding_model", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query()
def eval_run(spark, d):
    """All queries in all pipelines, with scores and top sources."""
    from .evaluate import pipeline_keys, records, results

    q = table(spark, d, "queries")
    return records(results(q, table(spark, d, "chunks"), pipeline_keys("all")), q).select("query_id", "pipeline", "grp", F.round("retrieval_score", 6).alias("retrieval_score"), F.array_join("top_chunk_ids", ",").alias("top_chunk_ids"))


@query()
def ab_test(spark, d):
    """Two chunk sizes over all documents."""
    from .evaluate import compare_chunkings

    return compare_chunkings(table(spark, d, "documents"), table(spark, d, "queries"), "doc_id", "text")


@query("select distinct record_id, nullif(file_hash, '') as file_hash, coalesce(course, '') as course from ingestion_manifest where regexp_matches(lower(path), '\\.(pdf|txt|md)\\z') and not starts_with(string_split(path, '/')[-1], '.')")
def supported_files(spark, d):
    """The deliveries of supported kinds."""
    from ..sources.files import EXTENSIONS

    rows = table(spark, d, "ingestion_manifest")
    keep = P.extension(F.col("path")).isin(*EXTENSIONS) & ~P.file_name(F.col("path")).startswith(".")
    return store.missing_as_empty(rows.where(keep), ["course"]).select("record_id", F.nullif("file_hash", F.lit("")).alias("file_hash"), "course").distinct()
