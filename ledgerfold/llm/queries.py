"""The queries of this subpackage, as the entry module registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with SQL that returns the same rows where there is any."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: DuckDB: lower-case A-Z only.
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""
    WITH d AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)
    """
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup_exact import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


#: DuckDB: the smallest id reachable from each of all(id) by links(a, b), both ways.
REACHED = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
    least AS (SELECT id, min(other) AS other FROM reach GROUP BY id)"""


@query(
    f"""
    WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    g AS MATERIALIZED (SELECT id, list_distinct(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d),
    n AS (SELECT id, len(s) AS n FROM g),
    u AS (SELECT id, unnest(s) AS x FROM g),
    p AS (SELECT a.id AS a, b.id AS b, count(*) AS n_both FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * n_both >= 80 * (na.n + nb.n - n_both)),
    {REACHED}
    SELECT n.id AS doc_id, n.n AS n_shingles, coalesce(least(n.id, other), n.id) AS component_id, n.id = coalesce(least(n.id, other), n.id) AS kept
    FROM n LEFT JOIN least ON least.id = n.id
    """
)
def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup_minhash import near_classes

    return near_classes(table(spark, sf_dir, "documents"), words=2).withColumnRenamed("id", "doc_id")


#: As the contract lists them. The SQL below still says block for net/de/.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


@query(
    """
    WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
    h AS (SELECT page_id, regexp_extract(r, '^[^/?#]*') AS raw, regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
    p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM h),
    rules AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'),
        ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) t(rh, rp, v)),
    best AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
        FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
    SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
    """
)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judged_urls

    return judged_urls(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


#: A conversation whose texts look like marks of templates.
HOSTILE = "\\### Assistant: </turn> ok"


@query(
    r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
    e AS (SELECT *, CASE WHEN role = 'assistant' THEN t ELSE '' END AS l,
        length(replace(replace(role, '&', '&amp;'), '<', '&lt;')) + length(replace(replace(t, '&', '&amp;'), '<', '&lt;')) + 19 AS n FROM c)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, md5(t))) AS turns_sha256,
        CAST(sum(length(l)) AS BIGINT) AS loss_chars, sha256(string_agg(l, '' ORDER BY turn, role, md5(t))) AS loss_sha256,
        CAST(sum(n) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
    """
)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import folded, read_back, rendered, turn_events

    hostile = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HOSTILE).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hostile)
    loss = F.array_join("loss_texts", "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(rendered(folded(turn_events(rows)))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


@query(
    f"""
    WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
    links AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95),
    {REACHED},
    n AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
    SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(vec_id, other), vec_id) AS component_id, vec_id = coalesce(least(vec_id, other), vec_id) AS kept
    FROM embeddings LEFT JOIN n ON n.id = vec_id LEFT JOIN least ON least.id = vec_id
    """
)
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dedup_embedding import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import public_tokenizer, token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizer(), 1024).withColumnRenamed("id", "doc_id")


@query()
def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed
    from .tokens import public_tokenizer

    return packed(table(spark, sf_dir, "documents"), public_tokenizer(), 2048, 1).drop("ids").withColumnRenamed("id", "doc_id")


@query()
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extracted

    return extracted(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


@query()
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    judged = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    shown = [F.round(c, 6).alias(c) for c in ("p_text", "p_host", "p_path", "p_quality")]
    return judged.select(F.col("id").alias("doc_id"), "host", "path", *shown, "kept")


#: Domains of the tables' sources, in order of their numbers modulo 4, and weights by level.
DOMAINS = ["web", "news", "books", "forum"]
WEIGHTS = {
    "domain": {"web": 400, "news": 300, "books": 200, "forum": 100},
    "lang": {"en": 500, "de": 200, "fr": 200, "es": 100},
}


def domain_of(source):
    number = F.regexp_extract(source, "([0-9]+)$", 1).cast("int") % 4
    out = F.lit("other")
    for i, name in enumerate(DOMAINS):
        out = F.when(number == i, name).otherwise(out)
    return out


def _level(above: str, keys: str, name: str, weight: str) -> str:
    """SQL that shares a budget out among children; see mixing.shared_out."""
    parent = ", ".join(k for k in keys.split(", ") if k != name)
    over = f"PARTITION BY {parent}" if parent else ""
    return f"""
        SELECT *, CASE WHEN is_full THEN capacity ELSE (budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({over})) * weight
            // nullif(w_all - sum(CASE WHEN is_full THEN weight ELSE 0 END) OVER ({over}), 0) END AS given
        FROM (SELECT *, (budget - c_before) * weight >= capacity * (w_all - w_before) AS is_full
            FROM (SELECT *, coalesce(sum(capacity) OVER o, 0) AS c_before, coalesce(sum(weight) OVER o, 0) AS w_before,
                    sum(weight) OVER ({over}) AS w_all
                FROM (SELECT {keys}, CAST({weight} AS BIGINT) AS weight, capacity, budget FROM (
                    SELECT {keys}, sum(tokens) * 3 AS capacity FROM leaves GROUP BY {keys}) {above})
                WINDOW o AS ({over} ORDER BY capacity // weight, (capacity % weight) / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
    """


@query(
    f"""
    WITH rows AS MATERIALIZED (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
            coalesce(['web', 'news', 'books', 'forum'][TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4 + 1], 'other') AS domain,
            coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS tokens FROM documents),
    leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM rows GROUP BY ALL),
    total AS (SELECT CAST(sum(tokens) * 50 // 100 AS BIGINT) AS budget FROM leaves),
    a AS ({_level("CROSS JOIN total", "domain", "domain", "CASE domain WHEN 'web' THEN 400 WHEN 'news' THEN 300 WHEN 'books' THEN 200 WHEN 'forum' THEN 100 ELSE 100 END")}),
    b AS ({_level("JOIN (SELECT domain, given AS budget FROM a) USING (domain)", "domain, lang", "lang", "CASE lang WHEN 'en' THEN 500 WHEN 'de' THEN 200 WHEN 'fr' THEN 200 WHEN 'es' THEN 100 ELSE 100 END")}),
    c AS ({_level("JOIN (SELECT domain, lang, given AS budget FROM b) USING (domain, lang)", "domain, lang, source", "source", "100")}),
    given AS (SELECT domain, lang, source, coalesce(CAST(c.given AS BIGINT) // nullif(leaves.tokens, 0), 0) AS epochs,
        CAST(c.given AS BIGINT) - coalesce(CAST(c.given AS BIGINT) // nullif(leaves.tokens, 0), 0) * leaves.tokens AS rest
        FROM c JOIN leaves USING (domain, lang, source)),
    keyed AS (SELECT *, md5('7:' || epochs || ':' || doc_id) AS key FROM rows JOIN given USING (domain, lang, source)),
    run AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM keyed),
    part AS (SELECT *, CAST(greatest(0, least(tokens, rest - before)) AS BIGINT) AS part_tokens FROM run)
    SELECT doc_id, domain, lang, source, tokens, epochs, part_tokens, epochs * tokens + part_tokens AS taken_tokens
    FROM part WHERE epochs * tokens + part_tokens > 0
    """
)
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_sources

    drawn = mixed_sources(table(spark, sf_dir, "documents"), domain_of(F.col("source")), WEIGHTS, percent=50, max_epochs=3, seed=7)
    return drawn.withColumnRenamed("id", "doc_id")


#: What the shards of documents are ordered by, and their number.
SHARD_DIMS, SHARDS = ["lang", "source", "<bytes>"], 40


#: DuckDB: unsigned CRC-32 of a text's UTF-8, a bit of each byte in a step.
CRC32 = """xor(list_reduce(flatten(list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: [CAST('0x' || h AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
        lambda c, v: CASE WHEN xor(c, v) % 2 = 1 THEN xor(xor(c, v) // 2, 3988292384) ELSE xor(c, v) // 2 END, 4294967295), 4294967295)"""


def _bins(dim: str) -> str:
    """SQL: the cuts of one dimension; see sharding.cuts."""
    return f"""SELECT '{dim}' AS dim, min(v) AS v, bin FROM (SELECT v, (2 * sum(n) OVER (ORDER BY v) - n) * 32 // (2 * sum(n) OVER ()) AS bin
        FROM (SELECT {dim} AS v, count(*) AS n FROM d WHERE {dim} IS NOT NULL GROUP BY 1)) GROUP BY bin HAVING bin > 0"""


def _curve_sql() -> str:
    """SQL: the place on a Hilbert curve through 32 x 32 x 32 of a point (a, b, c)."""
    from .sharding import states

    moves = [i * 24 + after for row in states(3) for i, after in row]
    levels = ", ".join(f"(a >> {n}) % 2 + 2 * ((b >> {n}) % 2) + 4 * ((c >> {n}) % 2)" for n in range(4, -1, -1))
    return f"list_reduce([{levels}], lambda u, w: u // 24 * 192 + {moves}[u % 24 * 8 + w + 1], CAST(0 AS BIGINT)) // 24"


@query(
    f"""
    WITH d AS MATERIALIZED (SELECT doc_id, lang, substr(source, 1, 64) AS source, octet_length(encode(coalesce(text, ''))) AS bytes, md5(coalesce(text, '')) AS m, {CRC32.format("coalesce(text, '')")} AS crc FROM documents),
    l AS ({_bins("lang")}), s AS ({_bins("source")}), z AS ({_bins("bytes")}),
    p AS (SELECT *, (SELECT count(*) FROM l WHERE v <= lang) AS a, (SELECT count(*) FROM s WHERE v <= source) AS b, (SELECT count(*) FROM z WHERE v <= bytes) AS c FROM d),
    o AS (SELECT doc_id, bytes + 16 AS size, crc, sum(bytes + 16) OVER w AS upto, sum(bytes + 16) OVER () AS total, row_number() OVER w AS n
        FROM p WINDOW w AS (ORDER BY {_curve_sql()}, m, doc_id ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, CAST(least(39, (2 * upto - size) * 40 // (2 * total)) AS INT) AS shard FROM o)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, CAST(NULL AS INT) AS grown_shard FROM c
    """
)
def op11_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import sharded

    out = sharded(table(spark, sf_dir, "documents"), SHARDS, SHARD_DIMS)
    return out.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def branched(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with some turns of another one: (conv, at, said, words) and all (conv).

    Conversation c takes the first crc32(c) % 4 turns of conversation c - c % 20, as
    many as there are, in place of as many of its own.
    """
    from .scratch import stored

    turns = stored(turns)
    c = F.col("conv")
    taken = turns.groupBy("conv").agg(F.count("*").alias("n"))
    giver = taken.select(c.alias("giver"), F.col("n").alias("given"))
    info = taken.select("conv", (c - c % 20).alias("giver"), (F.crc32(c.cast("string").cast("binary")) % 4).alias("h")).join(giver, "giver", "left")
    info = stored(info.select("conv", "giver", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("taken")))
    own = turns.join(info, "conv").where("at > h").select("conv", (F.col("at") - F.col("h") + F.col("taken")).alias("at"), "said", "words")
    first = turns.where("at <= 3").withColumnRenamed("conv", "giver")
    lent = info.join(first, "giver").where("at <= taken").select("conv", "at", "said", "words")
    return own.unionByName(lent), info.select("conv")


@query(
    f"""
    WITH t AS (SELECT conv_id AS c, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS nth
        FROM conversations WHERE conv_id IS NOT NULL),
    n AS (SELECT c, count(*) AS n, {CRC32.format("CAST(c AS VARCHAR)")} % 4 AS h FROM t GROUP BY c),
    i AS (SELECT n.c, g.c AS giver, n.h, least(n.h, coalesce(g.n, 0)) AS taken FROM n LEFT JOIN n g ON g.c = n.c - n.c % 20),
    b AS (SELECT t.c, nth - h + taken AS nth, k FROM t JOIN i USING (c) WHERE nth > h UNION ALL SELECT i.c, nth, k FROM i JOIN t ON t.c = giver AND nth <= taken),
    l AS (SELECT i.c, coalesce(list(k ORDER BY nth) FILTER (nth IS NOT NULL), []) AS p FROM i LEFT JOIN b USING (c) GROUP BY i.c),
    m AS (SELECT c, d, p[1:d] AS p, len(p) = d AS ends FROM (SELECT c, p, unnest(range(0, len(p) + 1)) AS d FROM l)),
    f AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids FROM m GROUP BY p, d),
    ch AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM f WHERE d > 0 GROUP BY ALL),
    v AS (SELECT f.*, coalesce(ch.n, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(f.p[-1].x, '[^\x20\x09-\x0D]+')) END AS saved FROM f LEFT JOIN ch USING (p, d)),
    a AS (SELECT p[1:up] AS p, up AS d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM v) GROUP BY ALL)
    SELECT v.conv_id, v.d AS depth, o.conv_id AS parent_conv_id, v.n_convs, v.n_children, a.n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(v.ids) AS ends_sha256
    FROM v JOIN a ON a.p = v.p AND a.d = v.d LEFT JOIN f o ON v.d > 0 AND o.p = v.p[1:v.d - 1] AND o.d = v.d - 1
    """
)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .trie import numbered, trie

    turns = numbered(table(spark, sf_dir, "conversations"))
    return trie(*branched(turns)).drop("node", "parent")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document by crc32 of its id repeats a stretch of its words to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words"))
    n = F.size("words").cast("long")
    a = F.expr("g % size(words)")
    p = F.expr("1 + (size(words) - g % size(words)) div (3 + g % 8)")
    rows = rows.select("doc_id", "text", "words", F.when(n > 0, F.struct(a.alias("a"), p.alias("p"))).alias("at"))
    place = lambda i: F.when(i < F.col("at.a"), i).otherwise(F.col("at.a") + (i - F.col("at.a")) % F.col("at.p")).cast("int")
    again = F.array_join(F.transform(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", place(i))), " ")
    return rows.select("doc_id", F.when(F.col("at").isNotNull(), again).otherwise(F.col("text")).alias("text"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import periodic_runs

    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    none = F.get("runs", F.lit(0))

    def better(best, run):
        a, b = run["length"] * best["period"], best["length"] * run["period"]
        first = (run["start"] < best["start"]) | (run["start"] == best["start"]) & (run["period"] < best["period"])
        return F.when((a > b) | (a == b) & first, run).otherwise(best)

    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.withColumn("best", F.aggregate("runs", none, better)).select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        digest(F.array_join(F.transform("runs", line), "")).alias("runs_sha256"),
        digest(F.col("collapsed")).alias("collapsed_sha256"),
    )


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
