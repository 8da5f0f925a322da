"""Queries over knowledge tables and their upkeep."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import batches as bt
from ..operators import tables as tb
from .registry import register
from .tables import DOCS_V, snapshots, table


@register(f"WITH {DOCS_V} SELECT doc_id, fingerprint FROM docs_v2 UNION ALL SELECT doc_id, fingerprint FROM docs_v1 WHERE doc_id NOT IN (SELECT doc_id FROM docs_v2) AND doc_id % 20 <> 1")
def s6_upsert_delete(spark, sf_dir):
    """The second snapshot upserted into the first, then a list of ids deleted."""
    one, two = snapshots(spark, sf_dir)
    both = tb.upsert(one, two, "doc_id")
    return tb.delete(both, one.where("doc_id % 20 = 1 AND doc_id % 10 = 1"), "doc_id").select("doc_id", "fingerprint")


@register("SELECT DISTINCT l_partkey % 3000 AS doc_id, d.source FROM lineitem LEFT JOIN documents d ON d.doc_id = l_partkey % 3000")
def s7_fetch_by_ids(spark, sf_dir):
    """S7."""
    asked = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 3000).alias("doc_id")).distinct()
    return tb.fetch(asked, table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@register(f"""WITH {DOCS_V} SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'insert' WHEN b.doc_id IS NULL THEN 'remove' WHEN a.fingerprint = b.fingerprint THEN 'unchanged' ELSE 'update' END AS action
FROM docs_v1 a FULL JOIN docs_v2 b ON a.doc_id = b.doc_id""")
def i1_unchanged_skip(spark, sf_dir):
    """What a second ingest has to do for each document; unchanged ones are skipped."""
    return tb.compare(*snapshots(spark, sf_dir), "doc_id", "fingerprint")


@register(f"""WITH {DOCS_V} SELECT b.doc_id, coalesce(CASE WHEN a.fingerprint = b.fingerprint THEN 1 WHEN a.doc_id IS NOT NULL THEN 2 END, 1) AS revision, 'active' AS state FROM docs_v2 b LEFT JOIN docs_v1 a ON a.doc_id = b.doc_id""")
def i2_revisions(spark, sf_dir):
    """A changed document gets the next revision, and is active."""
    one, two = snapshots(spark, sf_dir)
    before = one.select("doc_id", F.col("fingerprint").alias("was"), F.lit(1).alias("previous"))
    same = F.col("was") == F.col("fingerprint")
    return two.join(before, "doc_id", "left").select("doc_id", F.when(same, F.col("previous")).otherwise(F.coalesce("previous", F.lit(0)) + 1).alias("revision"), F.lit("active").alias("state"))


_SENTENCES = "SELECT DISTINCT doc_id, sha256(concat(CAST(doc_id AS VARCHAR), ':', s)) AS chunk_id FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS s FROM {})"


def _sentences(docs):
    s = docs.select("doc_id", F.explode(F.split("text", r"\. ")).alias("s"))
    return s.select("doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "s"), 256).alias("chunk_id")).distinct()


@register(f"""WITH {DOCS_V}, a AS ({_SENTENCES.format('docs_v1')}), b AS ({_SENTENCES.format('docs_v2')})
SELECT coalesce(b.doc_id, a.doc_id) AS doc_id, count(*) FILTER (b.chunk_id IS NOT NULL AND a.chunk_id IS NOT NULL) AS reused, count(*) FILTER (a.chunk_id IS NULL) AS embedded, count(*) FILTER (b.chunk_id IS NULL) AS stale
FROM a FULL JOIN b ON a.chunk_id = b.chunk_id GROUP BY 1""")
def i3_vector_reuse(spark, sf_dir):
    """Chunks whose vectors are reused, that are embedded, and stale ones that go."""
    one, two = (_sentences(x) for x in snapshots(spark, sf_dir))
    both = one.select("chunk_id", F.col("doc_id").alias("a")).join(two.select("chunk_id", F.col("doc_id").alias("b")), "chunk_id", "full_outer")
    count = lambda c: F.sum(c.cast("long"))
    return both.groupBy(F.coalesce("b", "a").alias("doc_id")).agg(count(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("reused"), count(F.col("a").isNull()).alias("embedded"), count(F.col("b").isNull()).alias("stale"))


@register("""SELECT source, count(*) AS documents, count(*) FILTER (source IN ('src1', 'src2')) AS removed, CASE WHEN source IN ('src1', 'src2') THEN 'removed' ELSE 'active' END AS state FROM documents GROUP BY source""")
def i5_remove_sources(spark, sf_dir):
    """Sources that are removed, with the number of their documents that go."""
    gone = F.col("source").isin("src1", "src2")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(gone.cast("long")).alias("removed")).withColumn("state", F.when(gone, "removed").otherwise("active"))


@register("""SELECT doc_id, generate_subscripts(s, 1) - 1 AS ordinal, unnest(s) AS text FROM (SELECT doc_id, string_split(text, '. ') AS s FROM documents WHERE source = 'src3') ORDER BY 1, 2""")
def i6_inspect(spark, sf_dir):
    """The chunks of one source's documents in order."""
    d = table(spark, sf_dir, "documents").where("source = 'src3'")
    return d.select("doc_id", F.posexplode(F.split("text", r"\. ")).alias("ordinal", "text")).orderBy("doc_id", "ordinal")


@register(f"""WITH {DOCS_V} SELECT b.source, count(*) AS documents, count(*) FILTER (a.fingerprint = b.fingerprint) AS unchanged, sum(len(string_split(b.text, '. '))) AS chunks, count(*) FILTER (length(trim(b.text)) = 0) AS failures
FROM docs_v2 b LEFT JOIN docs_v1 a ON a.doc_id = b.doc_id GROUP BY b.source""")
def i7_ingest_summary(spark, sf_dir):
    """I7."""
    one, two = snapshots(spark, sf_dir)
    j = two.join(one.select("doc_id", F.col("fingerprint").alias("was")), "doc_id", "left")
    flag = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return j.groupBy("source").agg(F.count("*").alias("documents"), flag(F.col("was") == F.col("fingerprint")).alias("unchanged"), F.sum(F.size(F.split("text", r"\. "))).alias("chunks"), flag(F.btrim("text") == "").alias("failures"))


@register("""WITH RECURSIVE items AS (SELECT source AS key, doc_id AS o, greatest(1, coalesce(list_sum([CAST(ceil(length(w) / 4) AS BIGINT) FOR w IN regexp_extract_all(text, '[0-9A-Za-z_]+')]), 0) + length(regexp_replace(text, '[0-9A-Za-z_\\s]', '', 'g'))) AS t, 20000 AS bound FROM documents),
w AS (SELECT key, o, t, bound, row_number() OVER (PARTITION BY key ORDER BY o) AS i FROM items), f AS (SELECT key, i, o, 0 AS batch, 1 AS n, t FROM w WHERE i = 1 UNION ALL
SELECT f.key, w.i, w.o, f.batch + CAST(full_ AS INT), CASE WHEN full_ THEN 1 ELSE f.n + 1 END, CASE WHEN full_ THEN w.t ELSE f.t + w.t END FROM f JOIN w ON w.key = f.key AND w.i = f.i + 1, LATERAL (SELECT f.n >= 32 OR f.t + w.t > w.bound AS full_))
SELECT f.key AS source, f.o AS doc_id, w.t AS tokens, batch FROM f JOIN w ON w.key = f.key AND w.i = f.i""")
def i8_embedding_batches(spark, sf_dir):
    """I8: batches of at most 32 items and 20000 tokens, in order within a source."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", tx.model_tokens(F.col("text")).alias("tokens"))
    return bt.next_fit(d, "doc_id", "tokens", most_items=32, most_tokens=20_000, by="source")


_COS = "round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) , 9)"
_UNIT = "SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@register(f"""WITH n AS (SELECT vec_id, label, v[1:32] AS v FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM n),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {_COS} AS score FROM u a, u b WHERE a.vec_id % 50 = 0 AND a.label = b.label),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM p QUALIFY r <= 3)
SELECT (SELECT count(*) FROM n) AS new_rows, (SELECT count(*) FROM embeddings) AS old_rows, count(*) AS probes, bool_and(found) AS valid FROM (SELECT query_id, bool_or(query_id = doc_id) AS found FROM t GROUP BY query_id)""")
def i9_generation_report(spark, sf_dir):
    """Vectors re-made with half the dimensions; row counts agree and probes find themselves among their top 3."""
    old = table(spark, sf_dir, "embeddings")
    new = old.select(F.col("vec_id").alias("doc_id"), "label", F.slice("embedding", 1, 32).alias("v"))
    probes = new.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    top = tb.top_cosine(probes, new, 3, within=["label"])
    found = top.groupBy("query_id").agg(F.bool_or(F.col("query_id") == F.col("doc_id")).alias("found"))
    return found.agg(F.count("*").alias("probes"), F.bool_and("found").alias("valid")).crossJoin(new.agg(F.count("*").alias("new_rows"))).crossJoin(old.agg(F.count("*").alias("old_rows")))


@register("""WITH a AS (SELECT p_partkey AS id, p_name || p_brand AS f FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey AS id, p_name || p_brand || CASE WHEN p_partkey % 7 = 0 THEN '+' ELSE '' END AS f FROM part WHERE p_partkey % 10 <> 1)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'remove' WHEN a.f = b.f THEN 'unchanged' ELSE 'update' END AS action, CASE WHEN a.f = b.f THEN 1 WHEN a.id IS NULL THEN 1 ELSE 2 END AS revision FROM a FULL JOIN b ON a.id = b.id""")
def i12_catalog_sync(spark, sf_dir):
    """Two snapshots of a catalogue; absent entries are softly removed with the next revision."""
    p = table(spark, sf_dir, "part")
    name = F.concat("p_name", "p_brand")
    one = p.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("id"), name.alias("f"))
    two = p.where("p_partkey % 10 <> 1").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 7 == 0, F.concat(name, F.lit("+"))).otherwise(name).alias("f"))
    return tb.compare(one, two, "id", "f").withColumn("revision", F.when(F.col("action").isin("insert", "unchanged"), 1).otherwise(2))


@register(f"""WITH u AS ({_UNIT}) SELECT vec_id, len(v) = 64 AS valid, round(sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS length, round(v[1], 9) AS first FROM u""")
def i14_vector_checks(spark, sf_dir):
    """Vectors are checked and brought to length 1."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", tb.valid_vector(F.col("embedding"), 64).alias("valid"), tb.unit(F.col("embedding")).alias("v"))
    return e.select("vec_id", "valid", F.round(tb.norm(F.col("v")), 6).alias("length"), F.round(F.col("v")[0], 9).alias("first"))


@register("""WITH g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(length(text) - 2, 1) + 1), lambda i: substr(lower(text), i, 3))) AS g FROM documents),
c AS (SELECT doc_id, sha256(g) AS h, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT doc_id, CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) % 64 AS slot, sum(n) AS n FROM c GROUP BY ALL)
SELECT doc_id, slot, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 9) AS weight FROM s""")
def i15_trigram_vectors(spark, sf_dir):
    """I15."""
    return tb.trigram_vectors(table(spark, sf_dir, "documents"), 64).withColumn("weight", F.round("weight", 9))


@register("""SELECT lang, source, sha256(concat(lang, '|', source, '|', text)) AS key, count(*) AS requests, count(*) - 1 AS reused FROM documents GROUP BY ALL""")
def a15_embedding_reuse(spark, sf_dir):
    """Embedding requests with one identity, of which all but one are answered from memory."""
    key = F.sha2(F.concat_ws("|", "lang", "source", "text"), 256)
    return table(spark, sf_dir, "documents").groupBy("lang", "source", key.alias("key")).agg(F.count("*").alias("requests")).withColumn("reused", F.col("requests") - 1)
