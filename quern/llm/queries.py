"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat_format, decontaminate, embedding_dedup, html_text, language_id, lexical_search, merkle, packing, sharding, simhash_dedup, substring_dedup, url_filter, warc
from quern.llm.common import materialise

#: Where the public vocabularies lie; a parameter of every operator that needs one.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def tokenizer_path(name: str) -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join(TOKENIZERS, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures; the fetch day is a function of the id, as the table has none."""
    return table(spark, sf_dir, "pages").select("page_id", "url", (F.pmod(F.col("page_id") * 37, F.lit(365))).cast("int").alias("day"))


def list_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dated list drawn from the hosts and first path parts in the pages: each is blocked, lifted, allowed by its hash."""
    pages = table(spark, sf_dir, "pages")
    host = url_filter.host_of(F.col("url"))
    parent = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    prefix = F.concat(host, F.regexp_extract(F.regexp_replace("url", "^[a-z]+://[^/]*", ""), "^(/[^/?#]*/)", 1))
    patterns = pages.select(F.explode(F.array(host, parent, prefix)).alias("pattern")).filter("pattern <> ''").distinct()
    code = F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), 1, 6), 16, 10).cast("long")
    day = lambda k: F.pmod(code + F.lit(k * 97), F.lit(365)).cast("int")
    action = lambda k: F.element_at(F.array(F.lit("block"), F.lit("none"), F.lit("allow")), (F.pmod(code + F.lit(k), F.lit(3)) + 1).cast("int"))
    return patterns.select("pattern", F.explode(F.array(*[F.struct(day(k).alias("day"), action(k).alias("action")) for k in range(3)])).alias("e")).select("pattern", "e.day", "e.action")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(captures(spark, sf_dir), list_entries(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"))
    back = warc.read_archive(spark, archive)
    kind = back.schema["page_id"].dataType
    return back.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


#: Bytes of text in a shard of the registered query, at most, and the number of shards that a table is worth at least.
SHARD_BYTES, LEAST_SHARDS = 16 << 20, 64


def op5_sharding(spark: SparkSession, sf_dir: str, limit: int | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    total = 0 if limit else docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return sharding.shard(docs, limit or min(SHARD_BYTES, max(1, total // LEAST_SHARDS))).drop("text")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, tokenizer_path("piece_bpe_32k.model"))
    return language_id.predict(docs.select("doc_id", language_id.held_out().alias("held_out"), "text"), model, keep_text=False)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces_of(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), keep_ids=False).drop("ids")
    return packing.pack(pieces)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text")


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def tampered() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda text: merkle.leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    other = F.when(tampered() & F.col("text").contains("\n"), leaf(F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    found = merkle.build(docs.select(merkle.group_key(F.col("source")).alias("tree"), F.col("doc_id").alias("id"), leaf(F.col("text")).alias("digest"), other.alias("other")))
    out = merkle.prove(found).withColumn("folded_root", merkle.fold(F.coalesce("other", "digest"), F.col("path")))
    proof = F.sha2(F.array_join("path", "").cast("binary"), 256)
    root = F.lit(found.root).cast("string")
    return out.select(F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The conversation that every run of op13 adds to the table.
CONFLICT = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame(CONFLICT, "conv_id long, turn long, role string, text string")
    return chat_format.read_back(materialise(chat_format.format_conversations(rows.unionByName(more)), "chat"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_warc": op4_warc,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_packing": op8_packing,
    "op9_html_extraction": op9_html_extraction,
    "op10_simhash_dedup": op10_simhash_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_lexical_search": op12_lexical_search,
    "op13_chat_format": op13_chat_format,
}

_WORDS6 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def sharding_sql(limit: int | str) -> str:
    return f"""
WITH k AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key, coalesce(strlen(text), 0)::BIGINT AS b FROM documents),
s AS (SELECT d, key >> (60 - d) AS p, sum(b)::BIGINT AS b, count(*) AS n FROM k, range(61) t(d) GROUP BY ALL),
a AS (SELECT k.doc_id, s.d, s.p, s.b, s.n, min(s.d) OVER (PARTITION BY k.key) AS least FROM k JOIN s ON k.key >> (60 - s.d) = s.p WHERE s.b <= {limit} OR s.d = 60)
SELECT doc_id, CASE WHEN d = 0 THEN '' ELSE right(format('{{:060b}}', p), d::INT) END AS shard, d::INT AS shard_depth, b AS shard_bytes, n AS shard_rows, b > {limit} AS oversized FROM a WHERE d = least"""


ORACLES = {
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
k AS (SELECT a, min(c) AS c FROM r GROUP BY a)
SELECT v.vec_id, coalesce((SELECT count(*) FROM l WHERE l.a = v.vec_id), 0) AS n_links, k.c AS component_id, k.c = v.vec_id AS kept FROM v JOIN k ON k.a = v.vec_id""",
    "op2_substring_dedup": r"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, p, row_number() OVER (PARTITION BY array_to_string(w[p:p+19], ' ') ORDER BY doc_id, p) AS k FROM s),
c AS (SELECT DISTINCT doc_id, p + i AS p FROM g, range(20) t(i) WHERE k > 1),
x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS y FROM d),
k AS (SELECT doc_id, string_agg(y, ' ' ORDER BY p) AS t, count(*) AS n FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op3_url_filter": r"""
WITH p AS (SELECT page_id, url, ((page_id * 37) % 365)::INT AS day, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
n AS (SELECT DISTINCT unnest([host, regexp_extract(host, '([^.]+\.[^.]+)$', 1), host || regexp_extract(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^(/[^/?#]*/)', 1)]) AS pattern FROM p),
c AS (SELECT pattern, ('0x' || substr(md5(pattern), 1, 6))::BIGINT AS code FROM n WHERE pattern <> ''),
e AS (SELECT pattern, ((code + k * 97) % 365)::INT AS day, min(['block', 'none', 'allow'][(code + k) % 3 + 1]) AS action FROM c, range(3) t(k) GROUP BY ALL),
i AS (SELECT pattern, day AS f, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS t, action FROM e),
m AS (SELECT page_id, i.pattern, i.action, row_number() OVER (PARTITION BY page_id ORDER BY length(i.pattern) DESC, i.pattern DESC, i.action DESC) AS k
 FROM p JOIN i ON p.day >= i.f AND (i.t IS NULL OR p.day < i.t) AND i.action <> 'none' AND (p.host = i.pattern OR (ends_with(p.host, '.' || i.pattern) AND contains(i.pattern, '.')) OR (contains(i.pattern, '/') AND starts_with(p.host || p.path, i.pattern))))
SELECT p.page_id, p.url, p.day, coalesce(m.action = 'block', false) AS blocked, m.action, m.pattern FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.k = 1""",
    "op4_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN octet_length(b) < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN octet_length(b) < 100 OR page_id = first THEN NULL ELSE first END AS refers_to FROM f""",
    "op5_sharding": sharding_sql(f"(SELECT least({SHARD_BYTES}, greatest(1, sum(b) // {LEAST_SHARDS})) FROM k)"),
    "op6_decontamination": rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS6}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS6}, []) AS w FROM benchmark),
n AS (SELECT DISTINCT coalesce(item_id::VARCHAR, 'null') AS item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM n),
g AS (SELECT doc_id, i, z.n AS n, array_to_string(w[i:i + z.n - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) JOIN z ON i + z.n - 1 <= len(w)),
m AS (SELECT doc_id, i, g.n, item FROM g JOIN n ON g.n = n.n AND g.g = n.g),
h AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, range(13) t(j) WHERE j < m.n GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE poly AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce([k] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(k))),
d AS (SELECT doc_id, source, lang, n_chars, text, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT), lambda a, c: xor(a >> 8, t[(xor(a, c) & 255) + 1]))) % 2 = 0 AS bad FROM documents, poly),
f AS (SELECT *, CASE WHEN bad THEN replace(text, chr(10), '') ELSE text END AS other FROM d),
l AS (SELECT doc_id, source, sha256(h || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf, sha256(h || coalesce(strlen(other)::VARCHAR || ':' || other, '-')) AS seen,
 row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
 FROM (SELECT *, coalesce(strlen(doc_id::VARCHAR)::VARCHAR || ':' || doc_id, '-') || coalesce(strlen(source)::VARCHAR || ':' || source, '-') || coalesce(strlen(lang)::VARCHAR || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR)::VARCHAR || ':' || n_chars, '-') AS h FROM f)),
a AS (SELECT source, 0 AS level, i, n, leaf AS x FROM l UNION ALL SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(x, '' ORDER BY i)) FROM a WHERE n > 1 GROUP BY source, level, i // 3, n),
s AS (SELECT source, x, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM a WHERE n = 1),
b AS (SELECT 0 AS level, i, n, x FROM s UNION ALL SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(x, '' ORDER BY i)) FROM b WHERE n > 1 GROUP BY level, i // 3, n),
g AS (SELECT source, level, i // 3 AS run, list(x ORDER BY i) AS xs FROM a WHERE n > 1 GROUP BY ALL),
k AS (SELECT level, i // 3 AS run, list(x ORDER BY i) AS xs FROM b WHERE n > 1 GROUP BY ALL),
p AS (SELECT doc_id, g.level, (l.i // (3 ** g.level)::BIGINT) % 3 AS o, xs FROM l JOIN g ON g.source IS NOT DISTINCT FROM l.source AND g.run = l.i // (3 ** (g.level + 1))::BIGINT
 UNION ALL SELECT doc_id, 1000 + k.level, (s.i // (3 ** k.level)::BIGINT) % 3, xs FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source JOIN k ON k.run = s.i // (3 ** (k.level + 1))::BIGINT),
q AS (SELECT doc_id, list({'l': array_to_string(xs[1:o], ''), 'r': array_to_string(xs[o + 2:], '')} ORDER BY level) AS steps FROM p GROUP BY doc_id),
c AS (SELECT l.doc_id, leaf, s.x AS subroot, (SELECT x FROM b WHERE n = 1) AS root, coalesce(steps, []) AS steps, seen FROM l JOIN s ON s.source IS NOT DISTINCT FROM l.source LEFT JOIN q ON q.doc_id = l.doc_id),
z AS (SELECT *, list_reduce([{'l': '', 'r': seen}] || steps, lambda v, w: {'l': '', 'r': sha256(w.l || v.r || w.r)}).r AS folded_root FROM c)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda w: w.l || w.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM z""",
    "op12_lexical_search": rf"""
WITH d AS (SELECT doc_id, coalesce({_WORDS6}, []) AS w FROM documents),
g AS (SELECT count(*) AS all_docs, sum(len(w))::BIGINT AS all_terms FROM d WHERE len(w) > 0),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY ALL),
v AS (SELECT term, count(*) AS df FROM f GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(coalesce({_WORDS6}, [])) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_docs) // all_terms))))::BIGINT AS score FROM q JOIN f USING (term) JOIN v USING (term), g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 10""",
    "op13_chat_format": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(k)),
e AS (SELECT *, length('### ' || role || ': ' || regexp_replace(regexp_replace(text, '(\\*)({chat_format.CONTROL})', '\1\1\\\2', 'g'), '(\\+)$', '\1\1') || '</turn>' || chr(10)) AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
}
