"""Registered queries: text functions, lexical and vector retrieval, fusion and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from sourcelight.functions.text import citation_uri, meaningful_terms, normalized_tokens, parse_citation, token_set, truncate_utf8
from sourcelight.operators import fusion, lexical, vector
from sourcelight.operators.catalog import open_citations, open_images
from sourcelight.operators.segments import SearchIndex
from sourcelight.plans.registry import query
from sourcelight.session import scratch_dir


@query("token_set", r"""
    SELECT doc_id, len(s) AS tokens, array_to_string(list_sort(s), ' ') AS token_list
    FROM (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}')) AS s FROM documents)""")
def _(i):
    s = token_set("text")
    return i.texts().select("doc_id", F.size(s).cast("bigint").alias("tokens"), F.array_join(F.array_sort(s), " ").alias("token_list"))


@query("normalized_tokens", r"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}'), ' ') AS normalized FROM documents")
def _(i):
    return i.texts().select("doc_id", normalized_tokens("text").alias("normalized"))


@query("build_postings", "SELECT term, field, chunk_id, version_id, tf, len FROM postings", "postings")
def _(i):
    return lexical.postings(lexical.build_index(i.current()))


def _changed_index(i) -> SearchIndex:
    """A stored index of all passages, those of web pages with other words, into which the right ones were put."""
    chunks = i.current()
    web = F.col("version_id") % 9 == 8
    index = SearchIndex.create(chunks.withColumn("body", F.when(web, F.concat(F.lit("old "), F.reverse("body"))).otherwise(F.col("body"))), scratch_dir(i.spark))
    index.replace_versions(chunks.filter(web))
    return index


@query("replace_version_postings", "SELECT term, field, chunk_id, version_id, tf, len FROM postings", "postings")
def _(i):
    return _changed_index(i).postings()


@query("compact_index", "SELECT term, field, chunk_id, version_id, tf, len FROM postings WHERE version_id % 20 <> 1", "postings")
def _(i):
    # Versions that are missing are removed, then all segments become one.
    index = _changed_index(i)
    nothing = i.current().filter("false")
    index.replace_versions(nothing, i.sources().filter("state = 'missing'").select(F.col("current_version_id").alias("version_id")))
    index.compact()
    return index.postings()


@query("search_stored_index", "SELECT query_id, chunk_id, version_id, score, rank FROM lex", "lex")
def _(i):
    return _changed_index(i).search(i.queries(), 50)


@query("index_freshness", """
    SELECT (SELECT count(*) FROM current WHERE version_id % 9 <> 8) AS indexed,
           (SELECT count(*) FROM current) AS expected, true AS stale""", "current")
def _(i):
    # An index that lacks the web pages is stale.
    chunks = i.current()
    local = chunks.join(i.sources().filter("kind = 'local_file'").select("source_id"), "source_id", "left_semi")
    return lexical.index_freshness(lexical.build_index(local), chunks)


LEX_SQL = """
    SELECT query_id, chunk_id, rank, score, 'evidence://source/' || source_id || '/version/' || l.version_id || '#chunk-' || ordinal AS citation_uri
    FROM lex l JOIN current USING (chunk_id) WHERE rank <= 12"""


@query("lexical_search", LEX_SQL, "lex", "current")
def lexical_search(i):
    hits = lexical.lexical_search(i.queries(), i.current())
    return hits.select("query_id", "chunk_id", "rank", "score", citation_uri("source_id", "version_id", "ordinal").alias("citation_uri"))


@query("lexical_search_pruned", LEX_SQL, "lex", "current")
def _(i):
    # Same result by the route for corpora with very frequent words.
    hits = lexical.lexical_search(i.queries(), i.current(), hot_postings=200)
    return hits.select("query_id", "chunk_id", "rank", "score", citation_uri("source_id", "version_id", "ordinal").alias("citation_uri"))


@query("phrase_search", r"""
    SELECT phrase_id, chunk_id, 'body' AS field
    FROM (SELECT item_id AS phrase_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]{2,}'), ' ') || ' ' AS p FROM benchmark)
    JOIN (SELECT chunk_id, ' ' || array_to_string(regexp_extract_all(lower(body), '[\p{L}\p{N}]{2,}'), ' ') || ' ' AS b FROM current) ON contains(b, p)""", "current")
def _(i):
    phrases = i.table("benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    return lexical.phrase_search(phrases, i.current())


@query("vector_normalize", """
    SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS squared, round(v[1], 6) AS first, round(v[-1], 6) AS last
    FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(n)) AS v FROM (
        SELECT vec_id, e, list_sum(list_transform(e, lambda x: x * x)) AS n FROM (
            SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS e FROM embeddings)))""")
def _(i):
    scaled = i.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("vector"))
    v = F.col("vector")
    return vector.vector_normalize(scaled).select(
        "vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 6).alias("squared"),
        F.round(F.element_at(v, 1), 6).alias("first"), F.round(F.element_at(v, -1), 6).alias("last"),
    )


@query("vector_validate", """
    SELECT embedding_identity, batch_id, count(*) AS vectors, min(len(v)) AS dimension,
           CASE WHEN min(len(v)) <> max(len(v)) THEN 'ragged' WHEN bool_or(bad) THEN 'zero_norm' END AS reason
    FROM (SELECT CASE WHEN vec_id % 5 = 0 THEN 'm2' ELSE 'm1' END AS embedding_identity, label AS batch_id,
                 CASE WHEN label = 3 AND vec_id % 3 = 0 THEN embedding[1:32] WHEN label = 4 THEN list_transform(embedding, lambda x: x * 0) ELSE embedding END AS v,
                 label = 4 AS bad FROM embeddings) GROUP BY ALL""")
def _(i):
    # Label 3 gets short vectors and label 4 zero vectors.
    e, n = F.col("embedding"), F.col("label")
    v = F.when((n == 3) & (F.col("vec_id") % 3 == 0), F.slice(e, 1, 32)).when(n == 4, F.transform(e, lambda x: x * 0)).otherwise(e)
    rows = i.table("embeddings").select(F.when(F.col("vec_id") % 5 == 0, "m2").otherwise("m1").alias("embedding_identity"), n.alias("batch_id"), v.alias("vector"))
    return vector.vector_validate(rows).withColumn("dimension", F.col("dimension").cast("bigint"))


VEC_SQL = """
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT vec_id AS query_id, chunk_id, version_id, round(list_cosine_similarity(embedding::DOUBLE[], vector), 4) AS score
        FROM embeddings, vectors {where})) WHERE rank <= 10"""


@query("vector_topk", VEC_SQL.format(where=""), "vectors")
def _(i):
    q = i.table("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.vector_topk(q, i.vectors(), 10)


@query("vector_topk_identity", VEC_SQL.format(where="WHERE embedding_identity = 'm1'"), "vectors")
def _(i):
    q = i.table("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.vector_topk(q, i.vectors(), 10, identity="m1")


@query("vector_topk_tiles", VEC_SQL.format(where=""), "vectors")
def _(i):
    # The route for query tables that are too large to hand to every task.
    q = i.table("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.vector_topk(q, i.vectors(), 10, block_rows=200, tile_rows=256)


@query("collection_key", """
    SELECT embedding_identity, 'chunks_' || sha256(embedding_identity)[1:32] AS collection, count(*) AS vectors FROM vectors GROUP BY ALL""", "vectors")
def _(i):
    rows = i.vectors().withColumn("collection", vector.collection_key("embedding_identity"))
    return rows.groupBy("embedding_identity", "collection").agg(F.count(F.lit(1)).alias("vectors"))


@query("embedding_pending", f"""
    SELECT c.chunk_id, embedding_identity FROM current c LEFT JOIN vectors v USING (chunk_id)
    WHERE embedding_identity IS NULL OR embedding_identity <> 'm1'""", "current", "vectors")
def _(i):
    known = i.vectors().select("chunk_id", "embedding_identity")
    return vector.embedding_pending(i.current().select("chunk_id").join(known, "chunk_id", "left"), "m1")


@query("mark_embedded", f"""
    SELECT c.chunk_id, CASE WHEN v.chunk_id % 2000000 = 0 THEN 'm3' ELSE embedding_identity END AS embedding_identity
    FROM current c LEFT JOIN vectors v USING (chunk_id)""", "current", "vectors")
def _(i):
    known = i.vectors().select("chunk_id", "embedding_identity")
    chunks = i.current().select("chunk_id").join(known, "chunk_id", "left")
    return vector.mark_embedded(chunks, known.filter("chunk_id % 2000000 = 0"), "m3")


def count_model(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: counts that SQL can repeat."""
    return [[float(len(t)), float(t.count(" ")), float(t.count("e")), float(t.count("\n"))] for t in texts]


@query("embed_chunks", """
    SELECT chunk_id, 'counts' AS embedding_identity, CAST(length(body) AS DOUBLE) AS v1, CAST(length(body) - length(replace(body, ' ', '')) AS DOUBLE) AS v2,
           CAST(length(body) - length(replace(body, 'e', '')) AS DOUBLE) AS v3, CAST(length(body) - length(replace(body, chr(10), '')) AS DOUBLE) AS v4
    FROM current""", "current")
def _(i):
    made = vector.embed_chunks(i.current(), count_model, "counts")
    v = lambda n: F.element_at("vector", n).cast("double").alias(f"v{n}")
    return made.select("chunk_id", "embedding_identity", v(1), v(2), v(3), v(4))


def _lists(i):
    lex = lexical.lexical_scores(i.queries(), lexical.index_for(i.queries(), i.current()), 50)
    vec = vector.vector_topk(i.query_vectors().select("query_id", "vector"), i.vectors(), 50)
    return lex, vec


@query("rrf_fuse", "SELECT query_id, chunk_id, version_id, lexical_score, vector_score, fused_score, rank FROM fused", "fused")
def _(i):
    return fusion.rrf_fuse(*_lists(i))


@query("rerank", r"""
    SELECT query_id, chunk_id, score, rank, citation_uri FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation_uri) AS rank FROM (
        SELECT query_id, chunk_id, citation_uri, round(0.55 * greatest(0, least(1, s / top)) + 0.35 * len(list_intersect(qt, tt)) / len(qt)
                 + 0.10 * CASE WHEN contains(tn, qn) THEN 1 ELSE 0 END, 6) AS score
        FROM (SELECT *, max(s) OVER (PARTITION BY query_id) AS top, list_distinct(ql) AS qt, array_to_string(ql, ' ') AS qn, list_distinct(tl) AS tt, array_to_string(tl, ' ') AS tn
              FROM (SELECT l.query_id, l.chunk_id, l.score AS s, 'evidence://source/' || c.source_id || '/version/' || c.version_id || '#chunk-' || ordinal AS citation_uri,
                           regexp_extract_all(lower(query), '[\p{L}\p{N}]{2,}') AS ql, regexp_extract_all(lower(display_name || ' ' || body), '[\p{L}\p{N}]{2,}') AS tl
                    FROM lex l JOIN current c USING (chunk_id) JOIN queries USING (query_id) WHERE rank <= 30)))) WHERE rank <= 12""", "lex", "current", "queries")
def _(i):
    hits = lexical.lexical_search(i.queries(), i.current(), 50).join(i.queries(), "query_id").withColumnRenamed("body", "passage")
    return fusion.rerank(hits).select("query_id", "chunk_id", "score", "rank", "citation_uri")


def hybrid_hits(i):
    lex, vec = _lists(i)
    return fusion.merge_hybrid(i.queries(), lex, vec, i.current())


@query("hybrid_search", "SELECT query_id, chunk_id, score, rank, citation_uri FROM reranked", "reranked")
def hybrid_search(i):
    return hybrid_hits(i).select("query_id", "chunk_id", "score", "rank", "citation_uri")


STOPS = "['a','an','any','are','about','called','can','could','did','do','does','find','for','how','in','is','me','mention','mentioned','mentions','named','of','on','or','people','person','please','reference','references','refer','tell','there','the','these','this','those','that','to','what','when','where','who','why','with','would']"


@query("relevance_gate", rf"""
    SELECT query_id, chunk_id, rank FROM (
      SELECT *, list_filter(list_distinct(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]{{2,}}')), lambda t: NOT list_contains({STOPS}, t)) AS terms,
             regexp_extract_all(lower(passage), '[\p{{L}}\p{{N}}]{{2,}}') AS words FROM reranked)
    WHERE CASE WHEN len(terms) > 0 THEN list_has_any(terms, words) ELSE score > 0.55 END""", "reranked")
def _(i):
    return fusion.relevance_gate(hybrid_hits(i)).select("query_id", "chunk_id", "rank")


@query("meaningful_terms", rf"""
    SELECT doc_id, len(t) AS terms, array_to_string(list_sort(t), ' ') AS term_list FROM (
      SELECT doc_id, list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]{{2,}}')), lambda t: NOT list_contains({STOPS}, t)) AS t FROM documents)""")
def _(i):
    t = meaningful_terms("text")
    return i.texts().select("doc_id", F.size(t).cast("bigint").alias("terms"), F.array_join(F.array_sort(t), " ").alias("term_list"))


EVIDENCE_SQL = r"""
    WITH sized AS (
      SELECT query_id, rank, chunk_id, version_id, citation_uri, CAST(ceil(strlen(CAST(json_object('citation_uri', citation_uri, 'source_id', source_id, 'version_id', version_id,
          'chunk_id', chunk_id, 'ordinal', ordinal, 'display_name', display_name, 'heading', NULL,
          'coordinates', json_object('line_start', 1 + length(before) - length(replace(before, chr(10), '')),
                                     'line_end', 1 + length(before) - length(replace(before, chr(10), '')) + length(passage) - length(replace(passage, chr(10), ''))),
          'retrieved_at', '2024-06-01T00:00:00Z', 'passage', passage) AS VARCHAR)) / 4.0) AS BIGINT) AS tokens
      FROM (SELECT *, text[1 : CAST(char_start AS BIGINT)] AS before FROM reranked)),
    fold AS (
      SELECT query_id, CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS used, CAST([] AS BIGINT[]) AS versions, CAST([] AS BIGINT[]) AS ranks FROM (SELECT DISTINCT query_id FROM sized)
      UNION ALL
      SELECT f.query_id, s.rank, CASE WHEN ok THEN used + tokens ELSE used END, CASE WHEN ok THEN list_append(versions, s.version_id) ELSE versions END,
             CASE WHEN ok THEN list_append(ranks, s.rank) ELSE ranks END
      FROM fold f JOIN sized s ON s.query_id = f.query_id AND s.rank = f.place + 1,
           LATERAL (SELECT len(ranks) < 12 AND len(list_filter(versions, lambda v: v = s.version_id)) < 3 AND used + tokens <= 1500 AS ok))
    SELECT f.query_id, i - 1 AS idx, s.rank, s.tokens, s.citation_uri
    FROM (SELECT query_id, ranks, unnest(range(1, len(ranks) + 1)) AS i FROM (SELECT query_id, max_by(ranks, place) AS ranks FROM fold GROUP BY query_id)) f
    JOIN sized s ON s.query_id = f.query_id AND s.rank = f.ranks[f.i]"""


@query("select_evidence", EVIDENCE_SQL, "reranked", recursive=True)
def _(i):
    return fusion.select_evidence(hybrid_hits(i)).select("query_id", "idx", "rank", "tokens", "citation_uri")


@query("citation_uri", "SELECT chunk_id, 'evidence://source/' || source_id || '/version/' || version_id || '#chunk-' || ordinal AS uri FROM chunks", "chunks")
def _(i):
    return i.chunks().select("chunk_id", citation_uri("source_id", "version_id", "ordinal").alias("uri"))


@query("parse_citation", """
    SELECT page_id, uri, CASE WHEN page_id % 4 <> 3 THEN 's' || page_id END AS source_id, CASE WHEN page_id % 4 <> 3 THEN 'v' || len(url) END AS version_id,
           CASE WHEN page_id % 4 <> 3 THEN page_id END AS ordinal
    FROM (SELECT page_id, url, 'evidence://source/s' || page_id || '/version/v' || len(url) || CASE WHEN page_id % 4 = 3 THEN '#part-' ELSE '#chunk-' END || page_id AS uri FROM pages)""")
def _(i):
    p = F.col("page_id")
    mark = F.when(p % 4 == 3, "#part-").otherwise("#chunk-")
    uri = F.concat(F.lit("evidence://source/s"), p.cast("string"), F.lit("/version/v"), F.char_length("url").cast("string"), mark, p.cast("string"))
    return i.table("pages").select("page_id", uri.alias("uri")).withColumn("c", parse_citation("uri")).select("page_id", "uri", "c.*")


@query("open_citations", """
    SELECT citation_uri, chunk_id, c.source_id, c.ordinal, display_name, md5(body) AS passage_md5
    FROM (SELECT DISTINCT citation_uri, chunk_id FROM items) i JOIN chunks c USING (chunk_id) WHERE state <> 'deleted'""", "items", "chunks")
def _(i):
    wanted = i.claim_items().select("citation_uri").distinct()
    opened = open_citations(wanted, i.chunks().select("source_id", "version_id", "ordinal", "chunk_id", "body"), i.sources())
    return opened.select("citation_uri", "chunk_id", "source_id", "ordinal", "display_name", F.md5("body").alias("passage_md5"))


@query("open_images", """
    SELECT citation_uri, c.source_id, mime_type, CASE WHEN mime_type NOT LIKE 'image/%' THEN 'not_an_image' WHEN size > 268435456 THEN 'image_too_large' END AS reason,
           CASE WHEN mime_type LIKE 'image/%' AND size <= 268435456 THEN md5(base64(encode(text))) END AS payload_md5
    FROM (SELECT DISTINCT citation_uri, chunk_id FROM items) i JOIN chunks c USING (chunk_id),
         LATERAL (SELECT CASE c.source_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/tiff' WHEN 2 THEN 'text/plain' ELSE 'image/webp' END AS mime_type,
                         CASE WHEN c.source_id % 8 = 7 THEN 300000000 ELSE strlen(text) END AS size)
    WHERE state <> 'deleted'""", "items", "chunks")
def _(i):
    # Originals: the text bytes under an image type by rule, some with a stated size over the limit.
    s = F.col("source_id")
    mime = F.when(s % 4 == 0, "image/png").when(s % 4 == 1, "image/tiff").when(s % 4 == 2, "text/plain").otherwise("image/webp")
    originals = i.library().select("version_id", mime.alias("mime_type"), F.when(s % 8 == 7, 300000000).otherwise(F.octet_length("text")).cast("bigint").alias("byte_size"),
                                   F.encode("text", "UTF-8").alias("payload"))
    opened = open_images(i.claim_items().select("citation_uri").distinct(), i.chunks(), i.sources(), originals)
    plain = F.regexp_replace("bytes_base64", "[\r\n]", "")
    return opened.select("citation_uri", "source_id", "mime_type", "reason", F.md5(plain).alias("payload_md5"))


@query("truncate_utf8", """
    SELECT doc_id, k AS kept_bytes, md5(text[1 : c]) AS kept_md5 FROM (
      SELECT doc_id, text, list_max(list_filter(range(0, least(length(text), 1001) + 1), lambda n: strlen(text[1 : n]) <= 1001)) AS c FROM documents),
      LATERAL (SELECT strlen(text[1 : c]) AS k)""")
def _(i):
    cut = truncate_utf8("text", 1001)
    return i.texts().select("doc_id", F.octet_length(cut).cast("bigint").alias("kept_bytes"), F.md5(cut).alias("kept_md5"))
