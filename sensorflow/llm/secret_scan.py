"""Secret scans: fixed patterns, and compression novelty of tokens in sensitive contexts.

Tokens within WINDOW characters after a name with a sensitive word are candidates. A token's novelty is how many bytes it adds to a zstandard frame that
already holds the text around it without copies of the token, primed with a dictionary of identifiers, per character of the token. Words and identifiers
add little; random keys do not compress, however often they stand nearby.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorflow.llm.staging import worker_memo

# Fixed patterns: kind, pattern, group whose length counts, least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
PATTERNS = (
    ("assign", ASSIGN, 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}"), 0, 24),
)
KINDS = ("assign", "access", "hex", "novel")

LEAST = 8  # characters of a token right after the name and a separator
FAR_LEAST = 16  # and of any other token in the window
WINDOW = 64
SENSITIVE = re.compile(
    r"password|passwd|(?<![a-z])pwd(?![a-z])|passphrase|secret|token|api[_\-\x20]?key|private[_\-\x20]?key|access[_\-\x20]?key|auth|bearer|credential|signature|cookie|session"
    r"|://[^\s/:@]{0,64}:(?=[^\s/@]{1,256}@)",
    re.IGNORECASE | re.ASCII,
)
NAME_REST = re.compile(r"[A-Za-z0-9_./+-]*+")
SEPARATOR = re.compile(r"(?:\\?[\"'])?(?:[\x20\t]*+[:=]{1,2}>?[\x20\t]*+|[\x20\t]++(?:is[\x20\t]++)?)(?:\\?[\"'])?|", re.IGNORECASE | re.ASCII)
LINE_BREAKS = ("\n", "\r\n")
TOKEN = re.compile(r"[A-Za-z0-9+/_][A-Za-z0-9+/_-]*+(?:\.++[A-Za-z0-9+/_-]++)*+={0,2}")
IDENTIFIERS = (
    "abstract", "access", "account", "address", "admin", "allocate", "application", "argument", "array", "assert", "async", "attribute", "authentication", "authorization",
    "await", "backend", "basic", "bearer", "boolean", "bucket", "buffer", "cache", "callback", "catch", "certificate", "changeme", "character", "class",
    "client", "column", "command", "config", "configuration", "connection", "const", "constructor", "container", "content", "context", "controller", "cookie",
    "count", "create", "credential", "current", "database", "datetime", "default", "delete", "description", "directory", "document", "domain", "double",
    "download", "element", "email", "enabled", "encoding", "endpoint", "environment", "error", "example", "exception", "execute", "export", "extends",
    "false", "field", "filename", "filter", "float", "folder", "format", "function", "generate", "getattr", "handler", "header", "hidden", "hostname", "html",
    "http", "https", "identifier", "import", "include", "index", "initialize", "input", "insert", "instance", "integer", "interface", "internal", "iterator",
    "javascript", "json", "keyword", "lambda", "language", "length", "library", "listener", "local", "localhost", "location", "logger", "manager", "master",
    "message", "method", "module", "namespace", "network", "number", "object", "operation", "option", "output", "package", "parameter", "parent", "password",
    "pattern", "permission", "placeholder", "pointer", "position", "prefix", "private", "process", "production", "project", "property", "protected", "protocol",
    "provider", "public", "python", "query", "random", "record", "reference", "register", "release", "remote", "replace", "request", "required", "resource",
    "response", "result", "return", "sample", "schema", "script", "secret", "select", "server", "service", "session", "settings", "signature", "source", "static",
    "status", "string", "struct", "success", "template", "testing", "thread", "timeout", "timestamp", "token", "transaction", "undefined", "unsigned", "update", "user", "username", "value", "variable", "version",
)
AROUND = 256
TAIL = " " * 16  # zstandard looks for no match in the last 8 bytes
NOVELTY = 0.6  # of a token right after the name
FAR_NOVELTY = 0.75  # least, of any other token in the window
REPLACEMENT = "<secret>"


class Novelty:
    """Marginal compressed bytes against a dictionary of identifiers, in some spellings, and text."""

    def __init__(self, identifiers=IDENTIFIERS):
        words = [spelling for word in identifiers for spelling in (word, word.capitalize(), word.upper(), f"_{word}")]
        primed = zstandard.ZstdCompressionDict("\n".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False).compress

    def of(self, value: str, around: str) -> float:
        size = lambda middle: len(self.compress(f"{around}\n{middle}\n{TAIL}".encode("utf-8", "surrogatepass")))
        return (size(value) - size("")) / len(value)


def context(text: str, begin: int, end: int) -> str:
    """AROUND characters on each side of a value, each copy of the value in them blank, also one that the limit cuts."""
    value, blank = text[begin:end], " " * (end - begin)
    reach = AROUND + len(value)
    before = text[max(0, begin - reach) : begin].replace(value, blank)
    return before[-AROUND:] + text[end : end + reach].replace(value, blank)[:AROUND]


def novel(text: str, known: list[tuple[int, int]], novelty: Novelty, threshold: float = NOVELTY):
    """start and end of novel tokens that no span of ``known`` holds. Of a token that is not novel as a whole, its parts between dots are tried.

    A token belongs to the last name before it and is measured once; one on the line after a novel one, as in a block of a key, counts as next to the name. The time is linear in the text.
    """
    known = sorted(known)
    starts, ends = [a for a, _ in known], list(accumulate((b for _, b in known), max))
    held = lambda a, b: (i := bisect_right(starts, a)) > 0 and ends[i - 1] >= b
    measured, last, name = 0, 0, SENSITIVE.search(text)
    while name:
        at = name.end() if name[0].endswith(":") else NAME_REST.match(text, name.end()).end()
        limit, name = at + WINDOW, SENSITIVE.search(text, at)
        for token in TOKEN.finditer(text, max(at, measured)):
            begin, end = token.span()
            if begin >= limit or name and begin >= name.start():
                break
            near = SEPARATOR.fullmatch(text, at, begin) or (last and begin <= last + 2 and text[last:begin] in LINE_BREAKS)
            least, wanted = (LEAST, threshold) if near else (FAR_LEAST, max(threshold, FAR_NOVELTY))
            if end - begin < least:
                continue
            measured = end
            parts = [(begin + p.start(), begin + p.end()) for p in re.finditer(r"[^.]+", token[0]) if len(p[0]) >= least]
            for tried in ([(begin, end)], parts):
                found = [(a, b) for a, b in tried if not held(a, b) and novelty.of(text[a:b], context(text, a, b)) >= wanted]
                if found:
                    yield from found
                    last, limit = end, max(limit, end + 3)
                    break


def spans(text: str, novelty: Novelty, threshold: float = NOVELTY) -> list[tuple[str, int, int]]:
    """kind, start and end (code points, end exclusive), by start, then kind as in KINDS.

    Pattern spans are leftmost and non-overlapping per kind. A value whose novelty is at least ``threshold`` is a further
    span of kind novel unless a pattern span holds it; one that does not follow the name directly needs FAR_NOVELTY at least.
    """
    found = [(kind, m.start(), m.end()) for kind, pattern, group, least in PATTERNS for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    known = [(a, b) for _, a, b in found]
    return sorted(found + [("novel", a, b) for a, b in novel(text, known, novelty, threshold)], key=lambda span: (span[1], KINDS.index(span[0])))


def redacted(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each maximal stretch of spans replaced."""
    out, at = [], 0
    for _, begin, end in found:
        if begin >= at:
            out += [text[at:begin], REPLACEMENT]
        at = max(at, end)
    return "".join(out) + text[at:] if found else text


def scan(docs: DataFrame, text: str = "text", threshold: float = NOVELTY, redact: bool = False) -> DataFrame:
    """Add ``found``, an array of structs kind, start, end; with ``redact`` also replace the text.

    Null texts have no spans and stay null. Other columns and repeated rows pass unchanged; an input column named found is replaced.
    """
    keep = [c for c in docs.columns if c != "found"]
    at = keep.index(text)
    rows = docs.select(*[f"`{c}`" for c in keep])
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def search(batches):
        worker_memo().clear()
        novelty = Novelty()
        for batch in batches:
            texts, all_found = batch.column(at).to_pylist(), []
            for i, value in enumerate(texts):
                found = spans(value, novelty, threshold) if value else []
                all_found.append([dict(zip(("kind", "start", "end"), one)) for one in found])
                if redact and found:
                    texts[i] = redacted(value, found)
            columns = list(batch.columns)
            if redact:
                columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(all_found, span)], [*batch.schema.names, "found"])

    schema = rows.withColumn("found", F.expr("cast(null as array<struct<kind:string,start:bigint,end:bigint>>)")).schema
    return rows.mapInArrow(search, schema)


def summary(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_assign, n_access, n_hex, base_sha256 (of the pattern spans as kind:start:end, comma-joined) and spans (all of them, joined alike)."""
    joined = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined(F.filter("found", lambda s: s["kind"] != "novel"))
    return scanned.select(F.col(key), *[count(kind) for kind in KINDS[:3]], F.sha2(base, 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
