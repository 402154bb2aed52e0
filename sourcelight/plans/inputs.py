"""Input tables of the registered queries, derived by rule from the given Parquet tables.

The given tables hold no versions, states or claims, so those columns follow from the keys. ``Inputs`` is the
Spark side and ``CTE`` the same derivation in SQL; :func:`sql` puts the needed parts in front of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelight.functions.text import citation_uri, mime_type, words
from sourcelight.operators.catalog import current_chunks, searchable_versions
from sourcelight.operators.chunking import chunk_text
from sourcelight.session import stored
from sourcelight.sources.files import spread

CHUNK_KEY = 1_000_000  # more passages than a 64 MiB text can have
DRAFT_WORDS = 40
DRAFT_KEY = 100  # more drafts than a passage can have
NOW_SQL = "TIMESTAMP '2024-07-01 00:00:00'"
EXTENSIONS = [".md", ".html", ".json", ".yaml", ".csv", ".py", ".txt", ".bin"]
STATE_BY_EVENT = {"signup": "queued", "view": "running", "click": "cancelling", "purchase": "completed"}
# Common second words of the test texts, so that some claims match directly.
PREDICATES = ["and", "the", "was", "in", "of", "to", "is", "as", "for", "with", "la", "el", "der", "que", "un", "del"]


def now():
    return F.to_timestamp(F.lit("2024-07-01 00:00:00"))


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.drafts: DataFrame | None = None  # once they are written

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def texts(self) -> DataFrame:
        """The documents, spread over the cores where the files alone would give too few tasks."""
        return spread(self.table("documents"))

    def library(self, texts: bool = False) -> DataFrame:
        """One source with one version per document. ``texts``: spread for work on the texts."""
        d = F.col("doc_id")
        start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
        day = lambda n: start + F.make_dt_interval((d % n).cast("int"))
        return (self.texts() if texts else self.table("documents")).select(
            d.alias("source_id"), d.alias("version_id"), d.alias("current_version_id"),
            F.concat("source", F.lit("/"), "lang", F.lit("-"), d.cast("string"), F.lit(".txt")).alias("display_name"),
            F.concat(F.lit("file:///"), "source", F.lit("/"), d.cast("string")).alias("canonical_uri"),
            F.when(d % 9 == 8, "web_page").otherwise("local_file").alias("kind"),
            F.when(d % 20 == 0, "deleted").when(d % 20 == 1, "missing").when(d % 20 == 2, "unsupported").otherwise("active").alias("state"),
            (1 + d % 4).alias("authority_tier"),
            F.when(d % 3 == 0, "filesystem_event").when(d % 3 == 1, "daily").otherwise("weekly").alias("refresh_policy"),
            F.when(d % 7 != 0, day(200)).alias("last_checked_at"),
            day(300).alias("updated_at"), (d % 5 == 4).alias("watch_paused"), "text",
        )

    def sources(self) -> DataFrame:
        return self.library().drop("text", "version_id")

    def versions(self) -> DataFrame:
        mime = F.when(F.col("version_id") % 2 == 0, "text/plain").otherwise("text/markdown")
        return self.library().select("source_id", "version_id", mime.alias("mime_type"), F.octet_length("text").cast("bigint").alias("byte_size"))

    def chunks(self) -> DataFrame:
        """Passages of every document."""
        return self._chunked(self.library(texts=True).select("source_id", "version_id", "text"))

    def _chunked(self, versions: DataFrame) -> DataFrame:
        rows = chunk_text(versions)
        return rows.withColumn("chunk_id", F.col("version_id") * CHUNK_KEY + F.col("ordinal")).withColumn("heading", F.lit(None).cast("string"))

    def current(self) -> DataFrame:
        """Searchable passages with name and citation fields.

        Sources are looked at before their texts are cut, so nothing is cut in vain and no passage is shuffled.
        """
        live = searchable_versions(self.library(texts=True))
        return self._named(self._chunked(live.select("source_id", "version_id", "display_name", "text")))

    def joined_current(self) -> DataFrame:
        """The same from tables of passages and sources."""
        return self._named(current_chunks(self.chunks().drop("source_id"), self.sources()))

    def _named(self, live: DataFrame) -> DataFrame:
        return live.select(
            "chunk_id", "source_id", "version_id", "ordinal", "display_name", "heading", "body",
            F.struct("line_start", "line_end").alias("coordinates"), F.lit("2024-06-01T00:00:00Z").alias("retrieved_at"),
        )

    def queries(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))

    def vectors(self) -> DataFrame:
        v = F.col("vec_id")
        return self.table("embeddings").select(
            (v * CHUNK_KEY).alias("chunk_id"), v.alias("version_id"),
            F.when(v % 5 == 0, "m2").otherwise("m1").alias("embedding_identity"), F.col("embedding").alias("vector"),
        )

    def query_vectors(self) -> DataFrame:
        """A vector for each query: the one whose number is the query's."""
        return self.queries().join(self.table("embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")

    def files(self) -> DataFrame:
        d = F.col("doc_id")
        ext = F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (d % len(EXTENSIONS)).cast("int"))
        files = self.table("documents").select(
            F.concat(F.lit("/d/"), "source", F.lit("/"), d.cast("string"), ext).alias("path"), F.encode("text", "UTF-8").alias("content"), "doc_id"
        )
        return files.withColumn("mime_type", mime_type("path", "content"))

    # --- claims -----------------------------------------------------------

    def claim_drafts(self) -> DataFrame:
        """The drafts: one for every ``DRAFT_WORDS`` words of every passage. ``r`` is the number that rules go by.

        Texts are cut once: keys and words of the drafts are written, and what follows reads the columns it needs.
        """
        if self.drafts is None:
            # Each draft is cut out as a text and is a row before its words are looked for, so these are taken by compiled code.
            piece = F.regexp_extract_all("body", F.lit(r"(?U)(?:\S++\s*+){1,%d}+" % DRAFT_WORDS), F.lit(0))
            rows = self.chunks().select("chunk_id", "source_id", "version_id", "ordinal", F.posexplode(piece).alias("part", "piece"))
            rows = rows.withColumn("part", F.col("part").cast("bigint")).withColumn("w", words("piece"))
            word = lambda n: F.coalesce(F.get("w", F.lit(n)), F.lit(""))
            self.drafts = stored(rows.select(
                (F.col("chunk_id") * DRAFT_KEY + F.col("part")).alias("claim_id"), "chunk_id", "source_id", "version_id", "ordinal", "part",
                (F.col("source_id") + F.col("ordinal") + F.col("part")).alias("r"),
                word(0).alias("first"), word(1).alias("second"), word(2).alias("third"), F.array_join(F.slice("w", 3, DRAFT_WORDS), " ").alias("others"),
            ))
        return self.drafts

    def claims(self) -> DataFrame:
        """A claim of each draft: its first word, its second, and all the others, so all words of all passages are in claims."""
        r, first, alias = F.col("r"), F.col("first"), F.col("third")
        return self.claim_drafts().select(
            "claim_id", F.when(r % 23 == 5, 2).otherwise(1).alias("schema_version"),
            F.concat(F.lit("Topic "), (r % 8).cast("string")).alias("topic"), (r % 8).alias("topic_id"),
            F.when(r % 19 == 7, " ").otherwise(first).alias("subject"), F.col("second").alias("predicate"), F.col("others").alias("object"),
            F.when((r % 2 == 0) & (F.lower(alias) != F.lower(first)) & (alias != ""), F.array(alias))
            .otherwise(F.array().cast("array<string>")).alias("subject_aliases"),
            F.array().cast("array<string>").alias("object_aliases"), (r % 6 == 0).alias("inferred"), "r",
        )

    def claim_items(self) -> DataFrame:
        """Evidence of each draft: its own passage, the one before it, then first passages of documents with smaller numbers."""
        r, d, o = F.col("r"), F.col("source_id"), F.col("ordinal")
        n = F.when(r % 29 == 3, 13).when(r % 31 == 3, 0).otherwise(1 + r % 4).cast("int")
        rows = self.claim_drafts().select("claim_id", "source_id", "ordinal", "r", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("idx")).filter("idx >= 0 and idx < n")
        before = (F.col("idx") == 1) & (o > 0)
        target = F.when(before, d).otherwise(F.floor(d / (F.col("idx") + 1)).cast("bigint"))
        ordinal = F.when(F.col("idx") == 0, o).when(before, o - 1).otherwise(0)
        return rows.select(
            "claim_id", F.col("idx").cast("bigint").alias("idx"), citation_uri(target, target, ordinal).alias("citation_uri"),
            F.when((F.col("idx") == 1) & (r % 3 == 0), "contradicting").otherwise("supporting").alias("relationship"),
            (target * CHUNK_KEY + ordinal).alias("chunk_id"),
        )

    def stored_claims(self) -> tuple[DataFrame, DataFrame]:
        """Stored claims and their evidence: status by rule, at most four pieces of evidence."""
        c = self.claims().select(
            "claim_id", "topic_id", "subject", "predicate", "object", "inferred",
            F.when(F.col("r") % 3 == 0, "disputed").otherwise("supported").alias("status"),
            F.when(F.col("r") % 3 == 0, 0.5).otherwise(0.75).alias("confidence"),
        )
        items = self.claim_items().filter("idx < 4").select("claim_id", "chunk_id", "relationship")
        return c, items

    def chunk_places(self) -> DataFrame:
        """Passage keys with their source, without the bodies; from the drafts, if they are written, as each passage has a first one."""
        places = self.chunks() if self.drafts is None else self.drafts.filter("part = 0")
        return places.select("chunk_id", "source_id", "version_id", "ordinal")

    def topics(self) -> DataFrame:
        """Topics from the claims plus one without any claim; questions from the benchmark items."""
        used = self.table("documents").select((F.col("doc_id") % 8).alias("topic_id")).distinct()
        last = used.agg((F.max("topic_id") + 1).alias("topic_id"))
        asked = self.table("benchmark").groupBy((F.col("item_id") % 9).alias("topic_id")).agg(F.count(F.lit(1)).alias("n"))
        return used.unionByName(last).join(asked, "topic_id", "left").select(
            "topic_id", F.concat(F.lit("Topic "), F.col("topic_id").cast("string")).alias("label"),
            F.array_repeat(F.lit("open"), F.coalesce(F.col("n"), F.lit(0)).cast("int")).alias("questions"),
        )

    def schedule(self) -> DataFrame:
        """Refresh schedule rows for every third source."""
        d = F.col("doc_id")
        return self.table("documents").filter(d % 3 == 2).select(
            d.alias("source_id"), (now() + F.make_dt_interval((d % 5).cast("int") - 2)).alias("next_due_at"),
            F.when(d % 4 == 0, "claimed").when(d % 4 == 1, "retry").otherwise("scheduled").alias("state"),
            (d % 4).alias("attempts"), F.lit(None).cast("string").alias("last_error"), (now() - F.make_dt_interval(F.lit(30))).alias("updated_at"),
        )

    # --- conversations and answers ------------------------------------------

    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("conversation_id"), F.col("turn").alias("ordinal"), "role", F.col("text").alias("content"),
            F.sha2("text", 256).alias("content_sha256"),
        )

    def conversations(self) -> DataFrame:
        """Known conversations; one in ten is unknown."""
        c = F.col("conv_id")
        per = self.table("conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
        return per.filter(c % 10 != 9).select(
            c.alias("conversation_id"), F.concat(F.lit("Conversation "), c.cast("string")).alias("title"),
            (F.to_timestamp(F.lit("2024-01-01 00:00:00")) + F.make_dt_interval((F.col("last") * 3 % 7).cast("int"))).alias("updated_at"),
        )

    def questions(self) -> DataFrame:
        c = F.col("conv_id")
        return self.table("conversations").filter("role = 'user'").select(
            (c * 1000 + F.col("turn")).alias("question_id"), "conv_id", "turn", F.col("text").alias("question"),
            F.when(c % 13 == 0, "  ").otherwise("local").alias("provider"), F.lit("m").alias("model"),
        )

    def supplied(self) -> DataFrame:
        """Evidence given with each question: one to four citations, none for some conversations."""
        q = self.questions().select("question_id", "conv_id", "turn", "question")
        rows = q.filter(F.col("conv_id") % 11 != 5).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("conv_id") % 4)).alias("idx"))
        return rows.select("question_id", "idx", citation_uri("conv_id", "turn", "idx").alias("citation_uri"), "conv_id", "turn", "question")

    def drafted(self) -> DataFrame:
        """A typed answer per question, with faults by rule."""
        c, q = F.col("conv_id"), self.questions()
        none = F.array().cast("array<string>")
        supports = F.array(F.lit("direct"), F.lit("inference"), F.lit("disputed"))
        claims = F.transform(F.split("question", "\n"), lambda s, i: F.struct(
            s.alias("statement"), F.get(supports, i % 3).alias("support"), F.array((i % 2).cast("bigint")).alias("evidence"), none.alias("citations"),
        ))
        zero, far = F.array(F.lit(0).cast("bigint")), F.array(F.lit(7).cast("bigint"))
        return q.select(
            "question_id", "conv_id", "turn", F.lit("indexed").alias("form"),
            F.when(c % 17 == 0, 2).otherwise(1).cast("bigint").alias("schema_version"), F.col("question").alias("summary"),
            F.when(c % 9 == 4, F.concat(zero, zero)).when(c % 9 == 5, far).otherwise(zero).alias("summary_evidence"),
            none.alias("summary_citations"),
            F.when(c % 7 == 3, F.slice(claims, 1, 0)).otherwise(claims).alias("claims"),
            F.when(c % 5 == 0, F.array(F.lit("  "))).when(c % 5 == 1, F.array(F.lit("check dates"))).otherwise(none).alias("warnings"),
            F.when(c % 6 == 0, F.array(F.lit("more sources needed"))).otherwise(none).alias("unresolved_gaps"),
            F.lit(None).cast("string").alias("reason"),
        )

    def responses(self) -> DataFrame:
        """Raw replies in ten shapes: plain, wrapped, drifted and broken JSON."""
        rows = self.drafted().withColumn("variant", (F.col("conv_id") + F.col("turn")) % 10)
        claims = F.transform("claims", lambda c: F.struct(c["statement"].alias("statement"), c["support"].alias("support"), c["evidence"].alias("evidence")))
        cited = F.transform("claims", lambda c: F.struct(
            c["statement"].alias("statement"), c["support"].alias("support"),
            F.transform(c["evidence"], lambda i: F.concat(F.lit("uri-"), i.cast("string"))).alias("citations"),
        ))
        fields = {
            "schema_version": F.col("schema_version"), "summary": F.col("summary"), "summary_evidence": F.col("summary_evidence"),
            "claims": claims, "warnings": F.col("warnings"), "unresolved_gaps": F.col("unresolved_gaps"),
        }
        def text(**over):
            merged = {**fields, **over}
            return F.to_json(F.struct(*[v.alias(k) for k, v in merged.items() if v is not None]))
        plain, v = text(), F.col("variant")
        content = (
            F.when(v == 1, F.concat(F.lit("```json\n"), plain, F.lit("\n```")))
            .when(v == 2, F.concat(F.lit("Sure: "), plain, F.lit(" done.")))
            .when(v == 3, text(note=F.lit("extra")))
            .when(v == 4, text(summary=F.split("summary", " ")))
            .when(v == 5, text(summary_evidence=F.get("summary_evidence", F.lit(0))))
            .when(v == 6, text(schema_version=F.col("schema_version").cast("string")))
            .when(v == 7, text(summary_evidence=None, summary_citations=F.array(F.lit("uri-0")), claims=cited))
            .when(v == 8, F.concat(F.lit("no object here: "), F.substring_index("summary", "{", 1)))
            .when(v == 9, text(warnings=F.lit("one note")))
            .otherwise(plain)
        )
        return rows.select("question_id", content.alias("content"))

    # --- events -----------------------------------------------------------

    def task_events(self) -> DataFrame:
        t = F.col("event_type")
        state = F.lit("failed")
        for kind, value in STATE_BY_EVENT.items():
            state = F.when(t == kind, value).otherwise(state)
        return self.table("events").select(
            F.col("event_id").alias("sequence"), F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("timestamp"), state.alias("state"),
            F.concat(F.lit("phase-"), (F.col("event_id") % 4).cast("string")).alias("phase_name"),
            (F.col("value") / 1000).alias("progress"),
            F.when(t == "error", "failed").alias("error_code"), (t == "error").alias("recoverable"), F.col("value").alias("arrival"),
        )

    def observations(self) -> DataFrame:
        """File observations: user as file, event type as fingerprint, an error as a deletion."""
        return self.table("events").select(
            F.col("user_id").alias("path_key"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("fingerprint"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("observed_us"), F.col("event_id").alias("observation_id"),
        )

    def attempts(self) -> DataFrame:
        """Ingestion attempts, time squeezed by 1000 so that some fall into a cooldown."""
        return self.table("events").select(
            F.col("user_id").alias("path_key"), F.col("event_id").alias("observation_id"),
            F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("bigint").alias("observed_us"),
            (F.col("event_type") != "error").alias("ok"),
        )


CHUNK_COUNT = "CASE WHEN len(t) = 0 THEN 0 WHEN len(t) <= 500 THEN 1 ELSE 1 + CAST(ceil((len(t) - 500) / 425.0) AS BIGINT) END"

CTE: dict[str, tuple[list[str], str]] = {
    "library": ([], """
        SELECT doc_id AS source_id, doc_id AS version_id, doc_id AS current_version_id,
               source || '/' || lang || '-' || doc_id || '.txt' AS display_name,
               'file:///' || source || '/' || doc_id AS canonical_uri,
               CASE WHEN doc_id % 9 = 8 THEN 'web_page' ELSE 'local_file' END AS kind,
               CASE WHEN doc_id % 20 = 0 THEN 'deleted' WHEN doc_id % 20 = 1 THEN 'missing'
                    WHEN doc_id % 20 = 2 THEN 'unsupported' ELSE 'active' END AS state,
               1 + doc_id % 4 AS authority_tier,
               CASE doc_id % 3 WHEN 0 THEN 'filesystem_event' WHEN 1 THEN 'daily' ELSE 'weekly' END AS refresh_policy,
               CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 200) * INTERVAL 1 DAY END AS last_checked_at,
               TIMESTAMP '2024-01-01 00:00:00' + (doc_id % 300) * INTERVAL 1 DAY AS updated_at,
               doc_id % 5 = 4 AS watch_paused, text,
               CASE WHEN doc_id % 2 = 0 THEN 'text/plain' ELSE 'text/markdown' END AS mime_type, strlen(text) AS byte_size
        FROM documents"""),
    "worded": (["library"], r"SELECT *, regexp_extract_all(text, '\S+\s*') AS t, regexp_extract(text, '^\s*') AS lead FROM library"),
    "placed": (["worded"], f"SELECT *, unnest(range({CHUNK_COUNT})) AS ordinal FROM worded"),
    "chunks": (["placed"], rf"""
        SELECT source_id, version_id, ordinal, version_id * {CHUNK_KEY} + ordinal AS chunk_id, display_name, state,
               regexp_replace(array_to_string(t[ordinal * 425 + 1 : ordinal * 425 + 500], ''), '\s+$', '') AS body,
               least(500, len(t) - ordinal * 425) AS token_count,
               CAST(length(lead) + coalesce(list_sum(list_transform(t[1 : ordinal * 425], lambda x: length(x))), 0) AS BIGINT) AS char_start, text
        FROM placed"""),
    "current": (["chunks"], "SELECT * FROM chunks WHERE state NOT IN ('deleted', 'unsupported')"),
    "queries": ([], "SELECT item_id AS query_id, text AS query FROM benchmark"),
    "fieldtoks": (["current"], r"""
        SELECT chunk_id, version_id, field, regexp_extract_all(lower(x), '[\p{L}\p{N}]+') AS l
        FROM (SELECT chunk_id, version_id, 'display_name' AS field, display_name AS x FROM current
              UNION ALL SELECT chunk_id, version_id, 'body', body FROM current)"""),
    "postings": (["fieldtoks"], """
        SELECT term, field, chunk_id, version_id, count(*) AS tf, any_value(n) AS len
        FROM (SELECT chunk_id, version_id, field, len(l) AS n, unnest(l) AS term FROM fieldtoks) GROUP BY ALL"""),
    "lens": (["fieldtoks"], "SELECT field, count(*) AS n, sum(len(l)) / count(*) AS avg_len FROM fieldtoks GROUP BY field"),
    "qterms": (["queries"], r"""
        SELECT query_id, term, count(*) AS qtf FROM
            (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\p{L}\p{N}]+')) AS term FROM queries)
        GROUP BY ALL"""),
    "lexscores": (["postings", "lens", "qterms"], """
        SELECT query_id, chunk_id, any_value(version_id) AS version_id, round(sum(
                   qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 4) AS score
        FROM postings JOIN (SELECT term, field, count(*) AS df FROM postings GROUP BY ALL) USING (term, field)
             JOIN lens USING (field) JOIN qterms USING (term)
        GROUP BY query_id, chunk_id"""),
    "lex": (["lexscores"], """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lexscores) WHERE rank <= 50"""),
    "vectors": ([], f"""
        SELECT vec_id * {CHUNK_KEY} AS chunk_id, vec_id AS version_id, CASE WHEN vec_id % 5 = 0 THEN 'm2' ELSE 'm1' END AS embedding_identity,
               embedding::DOUBLE[] AS vector FROM embeddings"""),
    "vec": (["vectors", "queries"], """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
            SELECT query_id, v.chunk_id, v.version_id, round(list_cosine_similarity(e.embedding::DOUBLE[], v.vector), 4) AS score
            FROM queries JOIN embeddings e ON e.vec_id = query_id, vectors v)) WHERE rank <= 50"""),
    "fused": (["lex", "vec"], """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, chunk_id) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id, version_id ORDER BY fused_score DESC, chunk_id) AS v FROM (
              SELECT query_id, chunk_id, any_value(version_id) AS version_id, max(l) AS lexical_score, max(s) AS vector_score,
                     round(sum(1.0 / (60.0 + rank)), 6) AS fused_score
              FROM (SELECT query_id, chunk_id, version_id, rank, score AS l, NULL AS s FROM lex
                    UNION ALL SELECT query_id, chunk_id, version_id, rank, NULL, score FROM vec) GROUP BY query_id, chunk_id)) WHERE v <= 3)
        WHERE rank <= 30"""),
    "reranked": (["fused", "current", "queries"], r"""
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation_uri) AS rank FROM (
            SELECT query_id, query, chunk_id, source_id, version_id, ordinal, display_name, body AS passage, char_start, text, citation_uri,
                   round(least(1, greatest(0,
                     0.55 * CASE WHEN top > 0 THEN least(1, greatest(0, fused_score / top)) ELSE 0 END
                   + 0.35 * CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, tt)) / len(qt) ELSE 0 END
                   + 0.10 * CASE WHEN len(qt) > 0 AND contains(tn, qn) THEN 1 ELSE 0 END)), 6) AS score
            FROM (SELECT *, max(fused_score) OVER (PARTITION BY query_id) AS top,
                         list_distinct(ql) AS qt, array_to_string(ql, ' ') AS qn, list_distinct(tl) AS tt, array_to_string(tl, ' ') AS tn
                  FROM (SELECT f.query_id, query, f.chunk_id, c.source_id, c.version_id, ordinal, display_name, body, char_start, text, fused_score,
                               'evidence://source/' || c.source_id || '/version/' || c.version_id || '#chunk-' || ordinal AS citation_uri,
                               regexp_extract_all(lower(query), '[\p{L}\p{N}]{2,}') AS ql,
                               regexp_extract_all(lower(display_name || ' ' || body), '[\p{L}\p{N}]{2,}') AS tl
                        FROM fused f JOIN current c USING (chunk_id) JOIN queries USING (query_id))))) WHERE rank <= 12"""),
    "files": ([], f"""
        SELECT '/d/' || source || '/' || doc_id || ({EXTENSIONS!r})[doc_id % 8 + 1] AS path, text, doc_id,
               CASE doc_id % 8 WHEN 0 THEN 'text/markdown' WHEN 1 THEN 'text/html' WHEN 2 THEN 'application/json' WHEN 3 THEN 'application/yaml'
                    WHEN 4 THEN 'text/csv' WHEN 5 THEN 'text/x-python' WHEN 6 THEN 'text/plain'
                    ELSE CASE WHEN contains(hex(encode(text))[1:1024], '00') AND contains(text, chr(0)) THEN 'application/octet-stream'
                              WHEN strlen(text) > 512 AND hex(encode(text))[1025:1025] IN ('8', '9', 'A', 'B') THEN 'application/octet-stream'
                              ELSE 'text/plain' END END AS mime_type FROM documents"""),
    "claim_parts": (["chunks"], rf"""
        SELECT chunk_id * {DRAFT_KEY} + part AS claim_id, chunk_id, source_id, ordinal, w[part * {DRAFT_WORDS} + 1 : part * {DRAFT_WORDS} + {DRAFT_WORDS}] AS w, source_id + ordinal + part AS r
        FROM (SELECT chunk_id, source_id, ordinal, w, unnest(range((len(w) + {DRAFT_WORDS} - 1) // {DRAFT_WORDS})) AS part
              FROM (SELECT chunk_id, source_id, ordinal, regexp_extract_all(body, '\S+') AS w FROM chunks))"""),
    "cl": (["claim_parts"], r"""
        SELECT claim_id, CASE WHEN r % 23 = 5 THEN 2 ELSE 1 END AS schema_version, 'Topic ' || (r % 8) AS topic, r % 8 AS topic_id,
               CASE WHEN r % 19 = 7 THEN ' ' ELSE coalesce(w[1], '') END AS subject, coalesce(w[2], '') AS predicate,
               array_to_string(w[3:], ' ') AS object, coalesce(w[3], '') AS alias, coalesce(w[1], '') AS first, r % 6 = 0 AS inferred, r
        FROM claim_parts"""),
    "items": (["claim_parts"], f"""
        SELECT claim_id, idx, 'evidence://source/' || target || '/version/' || target || '#chunk-' || place AS citation_uri, target * {CHUNK_KEY} + place AS chunk_id, target, place,
               CASE WHEN idx = 1 AND r % 3 = 0 THEN 'contradicting' ELSE 'supporting' END AS relationship
        FROM (SELECT claim_id, idx, r, CASE WHEN idx = 1 AND ordinal > 0 THEN source_id ELSE source_id // (idx + 1) END AS target,
                     CASE WHEN idx = 0 THEN ordinal WHEN idx = 1 AND ordinal > 0 THEN ordinal - 1 ELSE 0 END AS place
              FROM (SELECT claim_id, source_id, ordinal, r, unnest(range(CASE WHEN r % 29 = 3 THEN 13 WHEN r % 31 = 3 THEN 0 ELSE 1 + r % 4 END)) AS idx FROM claim_parts))"""),
    "stored": (["cl"], "SELECT *, CASE WHEN r % 3 = 0 THEN 'disputed' ELSE 'supported' END AS status FROM cl"),
    "proof": (["items"], "SELECT * FROM items WHERE idx < 4"),
    "topics": ([], """
        SELECT topic_id, 'Topic ' || topic_id AS label, coalesce(n, 0) AS questions
        FROM (SELECT DISTINCT doc_id % 8 AS topic_id FROM documents UNION ALL SELECT max(doc_id % 8) + 1 FROM documents)
             LEFT JOIN (SELECT item_id % 9 AS topic_id, count(*) AS n FROM benchmark GROUP BY ALL) USING (topic_id)"""),
    "schedule": ([], f"""
        SELECT doc_id AS source_id, {NOW_SQL} + (doc_id % 5 - 2) * INTERVAL 1 DAY AS next_due_at,
               CASE doc_id % 4 WHEN 0 THEN 'claimed' WHEN 1 THEN 'retry' ELSE 'scheduled' END AS state, doc_id % 4 AS attempts,
               {NOW_SQL} - INTERVAL 30 DAY AS updated_at FROM documents WHERE doc_id % 3 = 2"""),
    "convs": ([], """
        SELECT conv_id AS conversation_id, 'Conversation ' || conv_id AS title,
               TIMESTAMP '2024-01-01 00:00:00' + (max(turn) * 3 % 7) * INTERVAL 1 DAY AS updated_at
        FROM conversations WHERE conv_id % 10 <> 9 GROUP BY conv_id"""),
    "questions": ([], """
        SELECT conv_id * 1000 + turn AS question_id, conv_id, turn, text AS question,
               CASE WHEN conv_id % 13 = 0 THEN '  ' ELSE 'local' END AS provider FROM conversations WHERE role = 'user'"""),
    "supplied": (["questions"], """
        SELECT question_id, idx, 'evidence://source/' || conv_id || '/version/' || turn || '#chunk-' || idx AS citation_uri
        FROM (SELECT question_id, conv_id, turn, unnest(range(conv_id % 4 + 1)) AS idx FROM questions WHERE conv_id % 11 <> 5)"""),
    "drafted": (["questions"], """
        SELECT question_id, conv_id, turn, CASE WHEN conv_id % 17 = 0 THEN 2 ELSE 1 END AS schema_version, question AS summary,
               CASE conv_id % 9 WHEN 4 THEN [0, 0] WHEN 5 THEN [7] ELSE [0] END AS se,
               CASE WHEN conv_id % 7 = 3 THEN [] ELSE list_transform(string_split(question, chr(10)),
                   lambda s, i: {'s': s, 'k': (['direct', 'inference', 'disputed'])[(i - 1) % 3 + 1], 'e': (i - 1) % 2}) END AS cs,
               CASE conv_id % 5 WHEN 0 THEN ['  '] WHEN 1 THEN ['check dates'] ELSE [] END AS w,
               CASE WHEN conv_id % 6 = 0 THEN ['more sources needed'] ELSE [] END AS g,
               (conv_id + turn) % 10 AS variant, CASE WHEN conv_id % 11 = 5 THEN 0 ELSE conv_id % 4 + 1 END AS given
        FROM questions"""),
    "tev": ([], """
        SELECT event_id AS sequence, user_id AS task_id, ts AS timestamp,
               CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'cancelling'
                    WHEN 'purchase' THEN 'completed' ELSE 'failed' END AS state,
               'phase-' || (event_id % 4) AS phase_name, value / 1000 AS progress,
               CASE WHEN event_type = 'error' THEN 'failed' END AS error_code, event_type = 'error' AS recoverable, value AS arrival FROM events"""),
    "latest": (["tev"], "SELECT * FROM tev QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY sequence DESC) = 1"),
    "obs": ([], """
        SELECT user_id AS path_key, CASE WHEN event_type <> 'error' THEN event_type END AS fingerprint, epoch_us(ts) AS observed_us, event_id AS observation_id FROM events"""),
    "attempts": ([], """
        SELECT user_id AS path_key, event_id AS observation_id, epoch_us(ts) // 1000 AS observed_us, event_type <> 'error' AS ok FROM events"""),
}


def sql(body: str, *needs: str, recursive: bool = False) -> str:
    """``body`` with the derivations it needs as common table expressions, each once and in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for parent in CTE[name][0]:
            add(parent)
        if name not in order:
            order.append(name)

    for name in needs:
        add(name)
    if not order:
        return body.strip()
    parts = ",\n".join(f"{n} AS ({CTE[n][1].strip()})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        body = ", " + body[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{body}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body}"
