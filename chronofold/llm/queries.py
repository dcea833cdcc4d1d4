"""The registered queries of this folder, each over its whole table, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronofold.llm.session import bound_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            bound_batches(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= {n} THEN list_distinct([array_to_string(ws[i:i + {n} - 1], ' ') FOR i IN range(1, len(ws) - {n} + 2)])
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= {p} * (any_value(a.n) + any_value(b.n) - count(*))),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN ways b ON r.y = b.x),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
"""


@query(NEAR_SQL.format(n=4, p=80) + """
SELECT doc_id, CAST(coalesce(len(sh), 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM s JOIN c ON s.doc_id = c.x""")
def op7_near_duplicates(spark, sf_dir):
    from chronofold.llm.near_duplicates import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


@query()
def op6_line_dedup(spark, sf_dir):
    """Per document: its lines left, the numbers of the lines that went, a digest of the text left."""
    from chronofold.llm.line_dedup import BY_LENGTH, dedup_lines
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), dropped="dropped_lines", widths=BY_LENGTH)
    return out.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), "dropped_lines",
                      F.sha2("text", 256).alias("text_sha256"))


@query()
def op8_decontamination(spark, sf_dir):
    """The benchmark items found in each document; documents without any have no row."""
    from chronofold.llm.decontamination import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op4_bpe(spark, sf_dir):
    import public_tokenizers

    from chronofold.llm import bpe
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(table(spark, sf_dir, "documents"), path)


def fold(parts: int):
    """crc32 of the decimal doc_id, modulo parts; -1 for a null doc_id, which is learned from and not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts, F.lit(-1))


@query()
def op3_language_id(spark, sf_dir):
    from chronofold.llm import language_id
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(fold(4) != 2))
    return language_id.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@query()
def op5_sharding(spark, sf_dir):
    from chronofold.llm.sharding import shard
    return shard(table(spark, sf_dir, "documents"))


@query()
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


@query()
def op2_vector_search(spark, sf_dir):
    from chronofold.llm.vector_search import nearest
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


@query()
def op10_quality(spark, sf_dir):
    from chronofold.llm import quality
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(fold(5) != 0).select("doc_id", "quality")
    model = quality.fit(docs.join(labels, "doc_id"))
    return quality.score(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score",
                                             (F.col("score") >= quality.LEAST_SCORE).cast("int").alias("predicted"))


@query()
def op1_license_scan(spark, sf_dir):
    from chronofold.llm.licenses import scan
    return scan(table(spark, sf_dir, "documents"))


def _normal(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '\\s+', ' ', 'g'))"


QUOTES_SQL = f"""
WITH RECURSIVE m AS (SELECT *, row_number() OVER () AS rid FROM conversations),
l AS (SELECT rid, conv_id, turn, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM m WHERE text IS NOT NULL),
d AS (SELECT *, regexp_extract(line, '^(?:\\s*>)+') AS pre FROM l),
q AS (SELECT *, length(pre)-length(replace(pre,'>','')) AS depth, CASE WHEN pre='' THEN line ELSE ltrim(substr(line, length(pre)+1)) END AS body FROM d),
g AS (SELECT *, i-row_number() OVER (PARTITION BY rid, depth ORDER BY i) AS island FROM q),
p AS (SELECT rid, conv_id, turn, depth, min(i) AS no, {_normal("string_agg(body, chr(10) ORDER BY i)")} AS whole, list({_normal("body")}) AS parts
 FROM g WHERE depth>0 GROUP BY rid, conv_id, turn, depth, island),
u AS (SELECT *, row_number() OVER () AS uid FROM (SELECT conv_id, turn, no, depth, whole AS h, 2*length(whole) AS w FROM p WHERE whole<>''
 UNION ALL SELECT conv_id, turn, no, depth, x, length(x) FROM (SELECT *, unnest(parts) AS x FROM p) WHERE x<>'' AND x<>whole)),
own AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (depth=0), '') AS own, max(depth) AS max_depth FROM q GROUP BY rid),
n AS (SELECT rid, count(*) AS n_quotes FROM p GROUP BY rid),
c AS (SELECT m.rid, m.conv_id, m.turn, m.role, CASE WHEN n.n_quotes>0 THEN trim(own.own, chr(10)) ELSE m.text END AS text, coalesce(n.n_quotes, 0) AS n_quotes,
 coalesce(own.max_depth, 0) AS max_depth FROM m LEFT JOIN own USING (rid) LEFT JOIN n USING (rid)),
a AS (SELECT DISTINCT conv_id, turn, h FROM (SELECT conv_id, turn, {_normal("text")} AS h FROM c UNION ALL SELECT conv_id, turn, {_normal("x")} FROM (
  SELECT conv_id, turn, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n(?:[ \\t\\r\\f\\x0b]*\\n)+'))) AS x FROM c)) WHERE h<>''),
f AS (SELECT u.uid, u.conv_id, u.turn, u.no, u.depth, u.w, max(a.turn) AS source FROM u JOIN a ON a.conv_id=u.conv_id AND a.h=u.h AND a.turn<u.turn GROUP BY ALL),
v AS (SELECT conv_id, turn, no, depth, source, sum(w) AS w FROM f GROUP BY ALL),
b AS (SELECT conv_id, turn, no, depth, max({{'w': w, 's': source}}) AS best FROM v GROUP BY ALL),
o AS (SELECT conv_id, turn, depth, best.s AS source, sum(best.w) AS w, count(*) AS n FROM b GROUP BY ALL),
parents AS (SELECT conv_id, turn, max({{'d': -depth, 'w': w, 's': source}}).s AS parent, sum(n) AS n_linked FROM o GROUP BY ALL),
anc AS (SELECT conv_id, turn, parent AS up FROM parents UNION ALL SELECT anc.conv_id, anc.turn, p2.parent FROM anc JOIN parents p2 ON p2.conv_id=anc.conv_id AND p2.turn=anc.up),
roots AS (SELECT conv_id, turn, min(up) AS root FROM anc GROUP BY ALL)
SELECT c.conv_id, c.turn, c.role, c.text, CAST(c.n_quotes AS BIGINT) AS n_quotes, CAST(c.max_depth AS INT) AS max_depth, CAST(coalesce(pa.n_linked, 0) AS BIGINT) AS n_linked,
 pa.parent AS parent_turn, coalesce(r.root, c.turn) AS root_turn, CASE WHEN c.conv_id IS NOT NULL AND c.turn IS NOT NULL THEN
 row_number() OVER (PARTITION BY c.conv_id, c.turn IS NULL ORDER BY coalesce(r.root, c.turn), c.turn, md5(concat_ws('|', c.role, c.text)))-1 END AS reply_order
FROM c LEFT JOIN parents pa ON pa.conv_id=c.conv_id AND pa.turn=c.turn LEFT JOIN roots r ON r.conv_id=c.conv_id AND r.turn=c.turn"""


@query(QUOTES_SQL)
def op9_quotations(spark, sf_dir):
    from chronofold.llm.quotations import link_quotations
    return link_quotations(table(spark, sf_dir, "conversations"))


@query()
def op13_simhash(spark, sf_dir):
    from chronofold.llm.simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SEARCH_SQL = f"""
WITH q AS (SELECT item_id, term, count(*) AS r FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents),
n AS (SELECT rid, doc_id, len(ts) AS n, ts FROM d WHERE len(ts) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM n) SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, s GROUP BY term, docs),
sc AS (SELECT item_id, rid, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * docs) // terms))))) AS BIGINT) AS score
  FROM tf JOIN n USING (rid) JOIN w USING (term) JOIN q USING (term), s GROUP BY item_id, rid, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 AND doc_id IS NOT NULL)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM o WHERE rank <= 10"""


@query(SEARCH_SQL)
def op11_lexical_search(spark, sf_dir):
    from chronofold.llm.lexical_search import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# crc32 of the decimal number, unsigned: eight steps a byte.
_CRC = """(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
 lambda acc, byte: list_reduce(list_prepend(xor(acc, byte), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295))"""
TRIE_SQL = f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS no FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT *, conv_id - conv_id % 100 AS opener, {_CRC} % 6 AS h FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id)),
m AS (SELECT a.conv_id, a.opener, a.h, least(a.h, coalesce(b.n, 0)) AS shared FROM c a LEFT JOIN c b ON b.conv_id = a.opener),
r AS (SELECT m.conv_id, o.no + 1 AS pos, role, text FROM m JOIN o ON o.conv_id = m.opener AND o.no < m.h
  UNION ALL SELECT m.conv_id, m.shared + o.no - m.h + 1, role, text FROM m JOIN o USING (conv_id) WHERE o.no >= m.h),
k AS (SELECT conv_id, pos, length(text) AS points, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY pos) AS key FROM r),
p AS (SELECT conv_id, pos, points, key, left(key, length(key) - 64) AS up FROM k UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c),
n AS (SELECT key, any_value(pos) AS depth, any_value(up) AS up, any_value(points) AS points, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY key),
ch AS (SELECT up AS key, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
lv AS (SELECT p.key, count(*) AS n_leaves FROM n ANTI JOIN ch USING (key) JOIN p USING (conv_id) GROUP BY p.key),
sv AS (SELECT p.key, sum((n.n_convs - 1) * n.points) AS saved FROM n JOIN p ON p.conv_id = n.conv_id AND p.pos <= n.depth GROUP BY p.key),
en AS (SELECT key, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max_by(key, pos) AS key FROM p GROUP BY conv_id) GROUP BY key)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, n_leaves,
 CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n LEFT JOIN n u ON u.key = n.up LEFT JOIN ch ON ch.key = n.key JOIN lv ON lv.key = n.key JOIN sv ON sv.key = n.key LEFT JOIN en ON en.key = n.key"""


@query(TRIE_SQL)
def op12_prefix_trie(spark, sf_dir):
    from chronofold.llm.prefix_trie import conversation_trie
    return conversation_trie(table(spark, sf_dir, "conversations"))
