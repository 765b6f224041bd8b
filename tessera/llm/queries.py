"""The registered queries of the corpus operators, and SQL that gives the same rows.

Each query applies its operator to the whole table with production parameters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.workspace import fresh_path, materialise

from . import bpe, exact_dedup, langid, maxent_lm, mixing, orc_tokens, pq_dedup, setsketch, spelling, substring_dedup, token_counts, topk_search


def tokenizer_file() -> str:
    """The vocabulary file of the queries; operators take any path."""
    import public_tokenizers  # only these queries need it

    return str(public_tokenizers.path("word_bpe_49k.json"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after a load, the removal of documents labelled toxic, and a new count of those of low quality.

    Both the load and the removal are committed twice, as a retry would.
    """
    rule = lambda v: F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(token_counts.VERSIONS[v]))
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", rule("words-1").alias("words"), rule("alnum-1").alias("alnum"))
    docs = materialise(docs, "token-counts")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    words, alnum = token_counts.counted(docs, "words-1", F.col("words")), token_counts.counted(docs, "alnum-1", F.col("alnum"))
    toxic = labels.where("toxic = 1").select("doc_id")
    poor = labels.where("coalesce(toxic, 0) <> 1 and quality = 0").select("doc_id")
    ledger = token_counts.Ledger(spark, fresh_path(spark, "token-ledger"))
    for _ in range(2):
        ledger.commit("load", token_counts.inserts(words))
        ledger.commit("toxic-out", token_counts.deletes(words.join(toxic, "doc_id", "left_semi")))
    ledger.commit("poor-again", token_counts.revisions(words.join(poor, "doc_id", "left_semi"), alnum.join(poor, "doc_id", "left_semi")))
    return ledger.totals()


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(documents(spark, sf_dir), size=35, keep_text=False)


def op3_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return maxent_lm.score(documents(spark, sf_dir), held)


def op4_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.9)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), tokenizer_file(), with_ids=False, with_decoded=False)


def op6_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "orc-tokens")
    orc_tokens.write(documents(spark, sf_dir), path, tokenizer_file(), end_id=1)
    return orc_tokens.manifest(spark, path)


#: No source is read more than this often.
MIX_REPEATS = 1.5


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.schedule(documents(spark, sf_dir), repeats=MIX_REPEATS)
    return drawn.withColumn("weight", F.round("weight", 9))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(langid.learnt()))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(documents(spark, sf_dir), words=5, percent=75)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(spark, f"{sf_dir}/documents.parquet").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir), least_length=5, least=3, one_in=97), lead=2)


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scale=64)
    return topk_search.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op1_token_counts": rf"""
        WITH c AS (
            SELECT doc_id, source, lang, len({_WORDS}) AS w, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')) AS a FROM documents
        ), l AS (
            SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id
        ), j AS (
            SELECT c.*, coalesce(l.toxic, 0) = 1 AS gone, coalesce(l.quality = 0, false) AS poor FROM c LEFT JOIN l USING (doc_id)
        )
        SELECT source, lang, CASE WHEN poor THEN 'alnum-1' ELSE 'words-1' END AS tokenizer,
               count(*)::BIGINT AS docs, sum(CASE WHEN poor THEN a ELSE w END)::BIGINT AS tokens
        FROM j WHERE NOT gone GROUP BY ALL""",
    "op2_substring_dedup": rf"""
        WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w),
        k AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM p),
        r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM r WHERE c > 1),
        each AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM w),
        left_over AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.j) AS kept, count(*) AS n FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.j = g.j WHERE g.j IS NULL GROUP BY 1)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN left_over USING (doc_id)""",
    "op4_pq": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
        ), reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a),
        c AS (SELECT node, min(other) AS component FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
        SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(component, e.vec_id) AS component_id, coalesce(component, e.vec_id) = e.vec_id AS kept
        FROM embeddings e LEFT JOIN n ON e.vec_id = n.a LEFT JOIN c ON e.vec_id = c.node""",
    "op7_mixing": rf"""
        WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS n_tokens FROM documents),
        s AS (SELECT source, sum(n_tokens)::BIGINT AS t FROM d GROUP BY 1 HAVING sum(n_tokens) > 0),
        p AS (SELECT source, t, t / (sum(t) OVER ())::DOUBLE AS p, (sum(t) OVER ())::DOUBLE AS total FROM s),
        g AS (SELECT k, sum(pow(p, k / {mixing.STEPS}::DOUBLE)) AS z, max(pow(p, k / {mixing.STEPS}::DOUBLE) / p) AS r FROM p, range(0, {mixing.STEPS} + 1) t(k) GROUP BY k),
        e AS (SELECT coalesce(min(k) FILTER (WHERE r / z <= {MIX_REPEATS}), {mixing.STEPS}) AS k FROM g),
        w AS (SELECT source, t, e.k::INTEGER AS k, pow(p, e.k / {mixing.STEPS}::DOUBLE) / (SELECT z FROM g WHERE g.k = e.k) AS weight, total FROM p, e),
        b AS (SELECT *, floor(weight * total)::BIGINT AS budget, floor(floor(weight * total) / t)::BIGINT AS epochs FROM w),
        x AS (SELECT d.doc_id, d.source, n_tokens, k, weight, budget, epochs, budget - epochs * t AS rest, md5('0:' || epochs || ':' || doc_id) AS key FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
        y AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY key) AS upto FROM x),
        c AS (SELECT doc_id, source, n_tokens, k, round(weight, 9) AS weight, budget, CASE WHEN n_tokens = 0 THEN 0 ELSE epochs + CASE WHEN upto - n_tokens < rest THEN 1 ELSE 0 END END::BIGINT AS copies FROM y),
        t AS (SELECT *, unnest(range(0, copies)) AS epoch FROM c),
        m AS (SELECT *, md5('0:' || epoch || ':' || doc_id) AS key FROM t)
        SELECT doc_id, source, n_tokens, k, weight, budget, copies, epoch::BIGINT AS epoch, ('0x' || substr(key, 1, 3))::INTEGER AS block,
               (row_number() OVER (PARTITION BY source, epoch, substr(key, 1, 3) ORDER BY key, doc_id) - 1)::INTEGER AS position FROM m
        UNION ALL
        SELECT *, NULL, NULL, NULL FROM c WHERE copies = 0""",
    "op9_setsketch": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
        s AS (SELECT DISTINCT doc_id, sha256(array_to_string(ws[i:i + 4], ' ')) AS h FROM p),
        n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 75 * (x.n + y.n - common)),
        e AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT a AS node, a AS other FROM e UNION SELECT r.node, e.b FROM reach r JOIN e ON r.other = e.a),
        c AS (SELECT node, min(other) AS component FROM reach GROUP BY 1)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(component, w.doc_id) AS component_id, coalesce(component, w.doc_id) = w.doc_id AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON w.doc_id = c.node""",
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM n WINDOW same AS (PARTITION BY t)""",
    "op11_spelling": r"""
        WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
        each AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY ALL),
        bytes AS (SELECT run, k, list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END).flatten() AS b FROM each),
        hashed AS (SELECT run, k, xor(list_reduce(list_concat([4294967295::BIGINT], b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM bytes, bits),
        spelt AS (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed),
        w AS MATERIALIZED (SELECT word, sum(k)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY 1 HAVING sum(k) >= 3),
        d AS MATERIALIZED (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
        near AS MATERIALIZED (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
        best AS (SELECT a, count(*) AS n_near, first(struct_pack(word := b, n := w.n) ORDER BY w.n DESC, b) AS top FROM near JOIN w ON b = w.word GROUP BY a),
        f AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top.n >= 2 * n THEN top.word END AS form, CASE WHEN top.n >= 2 * n THEN top.n END AS form_n FROM w LEFT JOIN best ON a = word),
        chain AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON c.at = f.word WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN chain c ON c.word = f.word JOIN f e ON e.word = c.at WHERE e.form IS NULL""",
    "op12_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
}


def queries() -> dict:
    own = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
