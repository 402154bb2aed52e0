"""Claims: assessment, direct matches, proposals, recording and entity resolution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sourcelight import constants as K
from sourcelight.functions.text import ascii_lower, citation_uri, collapse_ws, is_blank, strip_ws
from sourcelight.operators.answers import run_model
from sourcelight.operators.bounded import bounded_list
from sourcelight.operators.catalog import open_citations
from sourcelight.session import durable, stored

FIELDS = ["topic", "subject", "predicate", "object"]


def _small_claims(evidence: DataFrame) -> DataFrame:
    """Evidence of claims with at most 12 items; anything longer is rejected by count alone."""
    counts = evidence.groupBy("claim_id").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") <= K.MAX_CLAIM_EVIDENCE)
    return evidence.join(counts.select("claim_id"), "claim_id", "left_semi")


def assess_claims(drafts: DataFrame, evidence: DataFrame, allowed: DataFrame) -> DataFrame:
    """Status of each draft, or the first reason against it.

    ``evidence``: claim_id, idx, citation_uri, relationship. ``allowed``: claim_id (optional), citation_uri.
    """
    keys = ["claim_id", "citation_uri"] if "claim_id" in allowed.columns else ["citation_uri"]
    known = allowed.select(*keys).distinct().withColumn("__known", F.lit(True))
    return _assessed(drafts, evidence, _faults(_small_claims(evidence).join(known, keys, "left")))


def _faults(items: DataFrame, *more: Column) -> DataFrame:
    """The first fault of each claim. ``items``: claim_id, idx, citation_uri, __known. ``more`` are further aggregates."""
    repeated = Window.partitionBy("claim_id", "citation_uri").orderBy("idx")
    again = F.row_number().over(repeated) > 1
    fault = F.when(F.col("__known").isNull(), "invalid_citation").when(F.col("__again"), "duplicate_evidence")
    return items.withColumn("__again", again).withColumn("__fault", fault).groupBy("claim_id").agg(
        F.min_by("__fault", F.when(F.col("__fault").isNotNull(), F.col("idx"))).alias("fault"), *more)


def _assessed(drafts: DataFrame, evidence: DataFrame, detail: DataFrame) -> DataFrame:
    counts = evidence.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("relationship") == "supporting").alias("supporting"),
        F.bool_or(F.col("relationship") == "contradicting").alias("contradicting"),
    )
    # Fields are looked at before the joins, so their texts are sent only where they are asked for.
    faulty = F.when(F.col("schema_version") != 1, "unsupported_schema")
    for field in FIELDS:
        faulty = faulty.when(is_blank(field) | (F.octet_length(field) > K.MAX_FIELD_BYTES), f"invalid_field:{field}")
    rows = drafts.withColumn("__faulty", faulty).join(counts, "claim_id", "left").join(detail, "claim_id", "left")
    reason = (
        F.when(F.col("__faulty").isNotNull(), F.col("__faulty"))
        .when(F.col("n").isNull() | (F.col("n") > K.MAX_CLAIM_EVIDENCE), "invalid_evidence_count")
        .when(F.col("fault").isNotNull(), F.col("fault"))
        .when(~F.col("supporting"), "unsupported")
    )
    status = F.when(reason.isNull(), F.when(F.col("contradicting"), "disputed").otherwise("supported"))
    more = [c for c in detail.columns if c not in ("claim_id", "fault")]
    return rows.select(*drafts.columns, status.alias("status"), reason.alias("reason"), *more)


def direct_phrase(subject="subject", predicate="predicate", obj="object") -> Column:
    return F.lower(collapse_ws(F.concat_ws(" ", subject, predicate, obj)))


def is_direct_predicate(predicate="predicate", predicates: list[str] | None = None) -> Column:
    return ascii_lower(strip_ws(predicate)).isin(predicates or K.DIRECT_PREDICATES)


def direct_match(claims: DataFrame, passages: DataFrame, predicates: list[str] | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """Whether a passage of the claim holds "subject predicate object" word for word, and the predicate
    is one of the plain ones. ``passages``: claim_id, passage. White space is folded in the phrase only.

    With ``chunks`` (chunk_id, passage), ``passages`` is claim_id, chunk_id: the short phrases then go to the passages
    and no passage is copied for each claim that cites it.
    """
    phrases = claims.select("claim_id", direct_phrase().alias("phrase"), is_direct_predicate(predicates=predicates).alias("plain"))
    if chunks is None:
        joined = phrases.join(passages.select("claim_id", "passage"), "claim_id")
    else:
        joined = passages.select("claim_id", "chunk_id").join(phrases, "claim_id").join(chunks.select("chunk_id", "passage"), "chunk_id")
    hit = F.col("plain") & (F.col("phrase") != "") & F.contains(F.lower("passage"), F.col("phrase"))
    return joined.groupBy("claim_id").agg(F.bool_or(hit).alias("direct"))


def claims_from_proposals(
    batches: DataFrame, proposals: DataFrame, evidence: DataFrame, predicates: list[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Turn proposals with evidence indexes into drafts with citations; a batch passes or fails as a whole.

    ``batches``: batch_id, topic. ``proposals``: batch_id, claim_id, subject, predicate, object,
    subject_aliases, object_aliases, inferred, supporting, contradicting (arrays of indexes).
    ``evidence``: batch_id, idx, citation_uri, passage. Returns (batch reasons, drafts, draft evidence).
    """
    sizes = proposals.groupBy("batch_id").agg(F.count(F.lit(1)).alias("__n"))
    small = sizes.filter(F.col("__n") <= K.MAX_EXTRACTED_CLAIMS).select("batch_id")
    bounded = proposals.join(small, "batch_id", "left_semi")
    roles = F.concat(
        F.transform("supporting", lambda i: F.struct(i.alias("idx"), F.lit("supporting").alias("relationship"))),
        F.transform("contradicting", lambda i: F.struct(i.alias("idx"), F.lit("contradicting").alias("relationship"))),
    )
    used = bounded.select("batch_id", "claim_id", F.posexplode(roles).alias("pos", "r")).select(
        "batch_id", "claim_id", F.col("pos").cast("bigint").alias("pos"), F.col("r.idx").alias("idx"), "r.relationship"
    )
    known = evidence.select("batch_id", "idx", "citation_uri", "passage")
    bound = used.join(known, ["batch_id", "idx"], "left")
    index_fault = bound.groupBy("batch_id", "claim_id").agg(
        (F.bool_or(F.col("citation_uri").isNull()) | (F.countDistinct("idx") < F.count(F.lit(1)))).alias("bad")
    )
    match = bound.filter("relationship = 'supporting'").select("claim_id", "passage")
    direct = direct_match(bounded, match, predicates)
    drafts = (
        bounded.join(batches.select("batch_id", "topic"), "batch_id").join(direct, "claim_id", "left")
        .select(
            "batch_id", "claim_id", F.lit(1).alias("schema_version"), "topic", "subject", "predicate", "object",
            "subject_aliases", "object_aliases",
            (F.col("inferred") | ~F.coalesce("direct", F.lit(False))).alias("inferred"),
        )
    )
    items = bound.select("batch_id", "claim_id", F.col("pos").alias("idx"), "citation_uri", "relationship")
    cited = items.filter("citation_uri is not null").select("claim_id", "citation_uri")
    assessed = assess_claims(drafts, items.drop("batch_id"), cited)
    faults = (
        assessed.join(index_fault, ["batch_id", "claim_id"], "left")
        .withColumn("why", F.when(F.col("bad"), "invalid_extraction").otherwise(F.col("reason")))
        .groupBy("batch_id")
        .agg(F.min_by("why", F.when(F.col("why").isNotNull(), F.col("claim_id"))).alias("why"))
    )
    reasons = batches.join(sizes, "batch_id", "left").join(faults, "batch_id", "left").select(
        "batch_id",
        F.when(is_blank("topic") | (F.col("__n") > K.MAX_EXTRACTED_CLAIMS), "invalid_extraction").otherwise(F.col("why")).alias("reason"),
    )
    good = reasons.filter("reason is null").select("batch_id")
    return reasons, drafts.join(good, "batch_id", "left_semi"), items.join(good, "batch_id", "left_semi")


def record_claims(
    drafts: DataFrame, evidence: DataFrame, chunks: DataFrame, sources: DataFrame,
    predicates: list[str] | None = None, scheme: str = "evidence",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store drafts whose citations open and, unless inferred, whose words occur in a supporting passage.

    Returns (claims, claim_evidence, rejected). Claims over the evidence limit are rejected before any
    passage is opened.
    """
    evidence = evidence.select("claim_id", "idx", "citation_uri", "relationship")
    items = _small_claims(evidence)
    # Only words that can be found by a plain predicate are sent, and only to supporting passages.
    phrase = F.when(is_direct_predicate(predicates=predicates), F.nullif(direct_phrase(), F.lit("")))
    items_of = items.join(drafts.select("claim_id", phrase.alias("__phrase")), "claim_id")
    items_of = items_of.withColumn("__phrase", F.when(F.col("relationship") == "supporting", F.col("__phrase")))
    opened = open_citations(items_of, chunks.select("source_id", "version_id", "ordinal", "chunk_id", "body"), sources, scheme)
    # Passages are compared where they are opened; only keys and the outcome are kept, once, for what follows.
    opened = stored(opened.select(
        "claim_id", "idx", "chunk_id", "relationship", F.coalesce(F.contains(F.lower("body"), F.col("__phrase")), F.lit(False)).alias("direct"),
    ))
    # At most 12 items of a claim are opened; with their places in one row all that follows meets by claim.
    per = opened.groupBy("claim_id").agg(F.collect_set("idx").alias("__opened"), F.bool_or("direct").alias("direct"))
    seen = items.join(per, "claim_id", "left").withColumn("__known", F.when(F.array_contains("__opened", F.col("idx")), F.lit(True)))
    rows = _assessed(drafts, evidence, _faults(seen, F.bool_or(F.col("__known").isNull()).alias("__missing"), F.bool_or("direct").alias("direct")))
    reason = (
        F.when(F.col("__missing"), "citation_not_found")
        .when(~F.col("inferred") & ~F.coalesce("direct", F.lit(False)), "unsupported_evidence")
        .otherwise(F.col("reason"))
    )
    rows = rows.withColumn("reason", reason)
    confidence = F.when(F.col("status") == "supported", K.CONFIDENCE["supported"]).otherwise(K.CONFIDENCE["disputed"])
    claims = rows.filter("reason is null").select(
        "claim_id", "topic", "subject", "predicate", "object", "inferred", "status", confidence.alias("confidence")
    )
    kept = opened.join(claims.select("claim_id"), "claim_id", "left_semi").select("claim_id", "chunk_id", "relationship")
    return claims, kept, rows.filter("reason is not null").select("claim_id", "reason")


def topic_get_or_create(labels: DataFrame, topics: DataFrame) -> DataFrame:
    """Topic id per label: the smallest existing id, else a new id derived from the label."""
    existing = topics.groupBy("label").agg(F.min("topic_id").alias("__id"))
    fresh = F.substring(F.sha2("label", 256), 1, 32)
    return labels.select("label").distinct().join(existing, "label", "left").select(
        "label", F.coalesce("__id", fresh).alias("topic_id"), F.col("__id").isNull().alias("created")
    )


def alias_reason(name="name", aliases="aliases") -> Column:
    """Why a list of aliases is not acceptable, or NULL."""
    folded = F.transform(aliases, lambda a: F.lower(strip_ws(a)))
    bad = F.exists(aliases, lambda a: is_blank(a) | (F.octet_length(strip_ws(a)) > K.MAX_FIELD_BYTES))
    return F.when(
        (F.size(aliases) > K.MAX_ALIASES) | bad | F.array_contains(folded, F.lower(strip_ws(name)))
        | (F.size(F.array_distinct(folded)) < F.size(folded)),
        "invalid_aliases",
    )


def resolve_entities(mentions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resolve names in mention order: mention_no (unique), name, aliases.

    A mention takes the smallest id among the entity of its own name and the entity that holds the name as
    an alias, as far as they exist before it; else it makes an entity with its own number as id. An alias
    belongs to whoever listed it first. Returns (mention_no, entity_id), entities and aliases.

    Which entity an alias leads to can depend on another alias, on any number of earlier ones. Those chains
    are followed by pointer doubling over the names that are also aliases, so the number of rounds is the
    logarithm of the longest chain.
    """
    m = mentions.select("mention_no", strip_ws("name").alias("name"), F.lower(strip_ws("name")).alias("n"), "aliases")
    names = m.groupBy("n").agg(F.min("mention_no").alias("first"), F.min_by("name", "mention_no").alias("canonical"))
    listed = m.select("mention_no", "n", F.explode("aliases").alias("alias")).select(
        "mention_no", F.col("n").alias("owner"), strip_ws("alias").alias("alias"), F.lower(strip_ws("alias")).alias("a")
    )
    bound = listed.groupBy("a").agg(
        F.min_by(F.struct(F.col("mention_no").alias("at"), "owner", "alias"), "mention_no").alias("b")
    ).select("a", F.col("b.at").alias("at"), F.col("b.owner").alias("owner"), F.col("b.alias").alias("alias"))

    # Own entity of a name: it exists unless the name was already an alias at its first mention.
    own = names.join(bound.select(F.col("a").alias("n"), "at", "owner"), "n", "left").select(
        "n", "first", "canonical", "at", "owner", F.when(F.col("at").isNull() | (F.col("at") >= F.col("first")), F.col("first")).alias("own")
    )
    own = durable(own)
    parent = own.select(F.col("n").alias("owner"), F.col("at").alias("owner_at"), F.col("first").alias("owner_first"))
    chained = F.col("owner_at") < F.col("at")
    nodes = own.filter("at is not null").join(parent, "owner").select(
        "n", F.least("own", F.when(~F.coalesce(chained, F.lit(False)), F.col("owner_first"))).alias("val"),
        F.when(chained, F.col("owner")).alias("ptr"),
    )
    nodes = durable(nodes)
    while not nodes.filter("ptr is not null").isEmpty():
        other = nodes.select(F.col("n").alias("ptr"), F.col("val").alias("val2"), F.col("ptr").alias("ptr2"))
        nodes = durable(nodes.join(other, "ptr", "left").select(
            "n", F.least("val", "val2").alias("val"), F.col("ptr2").alias("ptr")
        ))
    resolved = own.join(nodes.select("n", "val"), "n", "left").select("n", "own", "at", "val")
    entity = F.when(F.col("at") < F.col("mention_no"), F.col("val")).otherwise(F.col("own")).alias("entity_id")
    result = m.join(resolved, "n").select("mention_no", entity)
    entities = own.filter("own is not null").select(F.col("own").alias("entity_id"), F.col("canonical").alias("canonical_name"))
    # The mention that listed an alias is of its owner's name, so the entity follows from that name: no mention is read again.
    at = bound.select("a", "alias", F.col("at").alias("mention_no"), F.col("owner").alias("n"))
    aliases = at.join(resolved, "n").select(entity, "alias", F.col("a").alias("normalized_alias"))
    return result, entities, aliases


def claim_mentions(claims: DataFrame) -> DataFrame:
    """Subject and object of each claim as ordered mentions: 2 x claim number, then 2 x claim number + 1."""
    pair = F.array(
        F.struct((F.col("claim_id") * 2).alias("mention_no"), F.col("subject").alias("name"), F.col("subject_aliases").alias("aliases")),
        F.struct((F.col("claim_id") * 2 + 1).alias("mention_no"), F.col("object").alias("name"), F.col("object_aliases").alias("aliases")),
    )
    return claims.select(F.explode(pair).alias("m")).select("m.*")


def entity_relationships(claims: DataFrame, resolved: DataFrame) -> DataFrame:
    """One edge per claim between its two entities; an edge to itself is dropped."""
    by_claim = resolved.withColumn("claim_id", F.floor(F.col("mention_no") / 2).cast("bigint")).groupBy("claim_id").agg(
        F.min(F.when(F.col("mention_no") % 2 == 0, F.col("entity_id"))).alias("subject_id"),
        F.min(F.when(F.col("mention_no") % 2 == 1, F.col("entity_id"))).alias("object_id"),
    )
    edges = claims.select("claim_id", "predicate").join(by_claim, "claim_id")
    return edges.filter("subject_id <> object_id").select("claim_id", "subject_id", "predicate", "object_id")


# --- extraction -------------------------------------------------------------

_PROPOSAL = (
    "struct<subject:string,predicate:string,object:string,subject_aliases:array<string>,"
    "object_aliases:array<string>,inferred:boolean,supporting_evidence:array<bigint>,contradicting_evidence:array<bigint>>"
)
_PROPOSAL_KEYS = [
    "subject", "predicate", "object", "subject_aliases", "object_aliases", "inferred",
    "supporting_evidence", "contradicting_evidence",
]


def parse_proposals(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Read extraction replies: (batch_id, ok) and one row per proposal with claim_id = batch * 100 + place.

    The keys are closed: an unknown key or a missing required one fails the batch.
    """
    closed = F.array(*[F.lit(k) for k in _PROPOSAL_KEYS])
    v = F.try_parse_json("content")
    listed = F.try_variant_get(v, "$.claims", "array<variant>")
    keys_ok = F.forall(listed, lambda e: F.size(F.array_except(F.json_object_keys(F.to_json(e)), closed)) == 0)
    typed = F.try_variant_get(v, "$.claims", f"array<{_PROPOSAL}>")
    whole = F.forall(typed, lambda c: c.isNotNull() & c["subject"].isNotNull() & c["predicate"].isNotNull() & c["object"].isNotNull()
                     & c["supporting_evidence"].isNotNull()
                     & F.forall(F.concat(c["supporting_evidence"], F.coalesce(c["contradicting_evidence"], F.array().cast("array<bigint>"))),
                                lambda i: i.isNotNull() & (i >= 0)))
    top = F.json_object_keys("content") == F.array(F.lit("claims"))
    ok = F.coalesce(top & keys_ok & whole, F.lit(False))
    read = responses.select(F.col("question_id").alias("batch_id"), ok.alias("ok"), typed.alias("claims"))
    none = F.array().cast("array<string>")
    rows = read.filter("ok").select("batch_id", F.posexplode("claims").alias("place", "c")).select(
        "batch_id", (F.col("batch_id") * 100 + F.col("place")).alias("claim_id"), "c.subject", "c.predicate", "c.object",
        F.coalesce("c.subject_aliases", none).alias("subject_aliases"),
        F.coalesce("c.object_aliases", none).alias("object_aliases"),
        F.coalesce("c.inferred", F.lit(False)).alias("inferred"),
        F.col("c.supporting_evidence").alias("supporting"),
        F.coalesce("c.contradicting_evidence", F.array().cast("array<bigint>")).alias("contradicting"),
    )
    return read.select("batch_id", "ok"), rows


def extraction_prompts(topics: DataFrame, hits: DataFrame) -> DataFrame:
    """Numbered passages (12 at most) of each topic as one prompt. ``hits``: batch_id, idx, passage.

    A topic with more passages gets no prompt.
    """
    grouped = bounded_list(hits.select("batch_id", "idx", "passage"), "batch_id", "idx", ["passage"], K.MAX_EXTRACTED_CLAIMS, "p")
    listed = F.array_join(F.transform("p", lambda x: F.concat(F.lit("["), x["idx"].cast("string"), F.lit("] "), x["passage"])), "\n\n")
    prompt = F.concat(F.lit("Topic: "), strip_ws("topic"), F.lit("\n\nRetained evidence:\n"), listed)
    return topics.join(grouped.filter("not p_over"), "batch_id").select(F.col("batch_id").alias("question_id"), prompt.alias("prompt"))


def extract_claims(
    topics: DataFrame, hits: DataFrame, chunks: DataFrame, sources: DataFrame,
    model: Callable[[list[str]], list[str]], predicates: list[str] | None = None, scheme: str = "evidence",
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Search hits to recorded claims: (claims, claim_evidence, rejected claims, batch reasons).

    ``topics``: batch_id, topic. ``hits``: batch_id, idx (0-based), source_id, version_id, ordinal, passage.
    """
    # The search result is made durable: prompt, replies and citations must all see the same passages.
    hits = durable(hits.select("batch_id", "idx", "source_id", "version_id", "ordinal", "passage"))
    evidence = hits.withColumn("citation_uri", citation_uri("source_id", "version_id", "ordinal", scheme))
    replies = durable(run_model(extraction_prompts(topics, hits), model))
    read, proposals = parse_proposals(replies)
    batches = topics.join(read.filter("ok").select("batch_id"), "batch_id", "left_semi").withColumn("topic", strip_ws("topic"))
    reasons, drafts, items = claims_from_proposals(batches, proposals, evidence, predicates)
    drafts, items = durable(drafts), durable(items)  # a few rows per topic, read several times below
    unread = read.filter("not ok").select("batch_id", F.lit("invalid_extraction").alias("reason"))
    many = hits.groupBy("batch_id").agg(F.max("idx").alias("m"), F.count(F.lit(1)).alias("n"))
    many = many.filter((F.col("m") >= K.MAX_EXTRACTED_CLAIMS) | (F.col("n") > K.MAX_EXTRACTED_CLAIMS))
    unread = unread.unionByName(many.join(topics, "batch_id", "left_semi").select("batch_id", F.lit("too_many_passages").alias("reason")))
    claims, stored, rejected = record_claims(drafts.drop("batch_id"), items.drop("batch_id"), chunks, sources, predicates, scheme)
    return claims, stored, rejected, reasons.unionByName(unread)
