"""Column expressions for text: all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcelight import constants as K

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[\p{IsAlphabetic}\p{N}]"
# All characters of Unicode white space, which are those of ``(?U)\s``.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it.

    Inside higher-order functions Spark does not share common subexpressions, so a costly value is bound to a
    lambda variable instead.
    """
    return F.transform(F.array(value), body)[0]


def strip_ws(c) -> Column:
    """Trim Unicode white space at both ends. Only the ends are looked at; a regular expression would try every space inside."""
    return F.btrim(col(c), F.lit(WHITE))


def is_blank(c) -> Column:
    return ~col(c).rlike(r"(?U)\S")


def words(c) -> Column:
    return F.regexp_extract_all(col(c), F.lit(r"(?U)\S++"), F.lit(0))


def collapse_ws(c) -> Column:
    return F.array_join(words(c), " ")


def ascii_lower(c) -> Column:
    return F.translate(col(c), _UPPER, _UPPER.lower())


def newlines(c) -> Column:
    """Line feeds in a text, counted by bytes: a text knows how many it has, but its characters have to be read."""
    c = col(c)
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n"), F.lit("")))).cast("bigint")


def normalize_text(c) -> Column:
    """Drop one leading byte order mark; make every line end a line feed."""
    return F.regexp_replace(F.regexp_replace(col(c), "\\A\ufeff", ""), "\r\n?", "\n")


def token_list(c) -> Column:
    """Letters-and-digits runs of two or more characters, lower-cased, in order."""
    found = F.regexp_extract_all(col(c), F.lit(WORD + "{2,}+"), F.lit(0))
    return F.transform(found, lambda t: F.lower(t))


def token_set(c) -> Column:
    return F.array_distinct(token_list(c))


def normalized_tokens(c) -> Column:
    return F.array_join(token_list(c), " ")


def index_tokens(c) -> Column:
    """Every word of a field, of any length, lower-cased."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(WORD + "++"), F.lit(0))
    return F.transform(found, lambda t: F.lower(t))


def meaningful_terms(c) -> Column:
    return F.array_except(token_set(c), F.array(*[F.lit(w) for w in K.STOP_WORDS]))


def truncate_utf8(c, limit) -> Column:
    """Longest prefix of at most ``limit`` bytes that ends between characters."""
    c = col(c)
    limit = F.lit(limit) if isinstance(limit, int) else limit
    raw = F.encode(c, "UTF-8")

    def cut(drop: int) -> Column:
        piece = F.substr(raw, F.lit(1), (limit - drop).cast("int")).cast("string")
        return F.when(F.is_valid_utf8(piece), piece)

    return F.when(F.octet_length(c) <= limit, c).otherwise(F.coalesce(*[cut(d) for d in range(4)], F.lit("")))


def file_uri(path) -> Column:
    escaped = F.transform(
        F.split(col(path), ""),
        lambda ch: F.when(ch.rlike(r"\A[A-Za-z0-9/_.~-]\z"), ch).otherwise(
            F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
        ),
    )
    return F.concat(F.lit("file://"), F.array_join(escaped, ""))


def file_path(uri) -> Column:
    """Inverse of :func:`file_uri`; NULL for anything else."""
    uri = col(uri)
    body = F.replace(F.substring(uri, 8, 2**31 - 1), F.lit("+"), F.lit("%2B"))
    return F.when(uri.startswith("file://"), F.try_url_decode(body))


def mime_type(path, content) -> Column:
    """Signature first, then extension, then a look at the first 512 bytes."""
    path, content = col(path), col(content)
    head = F.substring(content, 1, 512)
    lead = F.hex(F.substring(content, 1, 12))
    name = F.substring_index(path, "/", -1)
    ext = ascii_lower(F.regexp_extract(name, r"(?s)\A.+\.([^.]*)\z", 1))
    as_text = head.cast("string")
    out = F.when(lead.startswith(K.MIME_BY_SIGNATURE[0][0]), K.MIME_BY_SIGNATURE[0][1])
    for signature, mime in K.MIME_BY_SIGNATURE[1:]:
        out = out.when(lead.startswith(signature), mime)
    out = out.when(lead.startswith("52494646") & lead.endswith("57454250"), "image/webp")
    table = F.create_map(*[F.lit(x) for pair in K.MIME_BY_EXTENSION.items() for x in pair])
    plain = (F.instr(as_text, "\u0000") == 0) & F.is_valid_utf8(as_text)
    return out.otherwise(
        F.coalesce(F.try_element_at(table, ext), F.when(plain, "text/plain").otherwise("application/octet-stream"))
    )


def is_text_mime(mime) -> Column:
    mime = col(mime)
    return mime.startswith("text/") | mime.isin("application/json", "application/yaml", "application/xml")


def citation_uri(source_id, version_id, ordinal, scheme: str = "evidence") -> Column:
    part = [col(c).cast("string") for c in (source_id, version_id, ordinal)]
    return F.concat(F.lit(f"{scheme}://source/"), part[0], F.lit("/version/"), part[1], F.lit("#chunk-"), part[2])


def parse_citation(uri, scheme: str = "evidence") -> Column:
    """Struct of source_id, version_id, ordinal; NULL when the shape is wrong."""
    uri = col(uri)
    pattern = rf"\A{scheme}://source/([^/#]+)/version/([^/#]+)#chunk-(\d{{1,19}})\z"
    # One match: what it leaves has no two strokes in a row, as no part has any; a URI of another shape keeps its own.
    return F.when(uri.startswith(f"{scheme}://source/"), let(F.regexp_replace(uri, pattern, "$1/$2/$3"), lambda found: F.when(
        ~F.contains(found, F.lit("//")), let(F.split(found, "/"), lambda part: let(part[2].try_cast("bigint"), lambda ordinal: F.when(
            ordinal.isNotNull(), F.struct(part[0].alias("source_id"), part[1].alias("version_id"), ordinal.alias("ordinal"))))))))


def lines_of(c) -> Column:
    return F.split(col(c), "\n")
