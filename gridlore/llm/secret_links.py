"""Secret scans with multipart credential linking.

Base findings stand by themselves. Weak parts (identifiers, short or unlabelled secrets,
endpoints) are common in clean text, so one is reported only if a complementary part lies
near it in the same document: an identifier or endpoint needs a secret, a weak secret an
identifier or endpoint. Parts are found where the texts are read; linking is an interval
join of parts on (document, stretch of text).
"""

from __future__ import annotations

import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F, types as T

from gridlore.llm import tokens as _tokens
from gridlore.llm.store import free, keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
#: Code points between two parts that still belong together.
REACH = 400
#: Documents with linked parts that are sent to every executor, after counting them.
SENT_ROWS = 20_000

# The base patterns and their least lengths.
_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_LEAST, _ACCESS_LEAST = 12, 18

_IDENTIFIER = re.compile(r"""(?i:client_id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", re.ASCII)
_BLOB = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}")
_ENDPOINT = re.compile(r"""(?:https?|jdbc:[a-z]+|amqp|redis|mongodb)://[^\s"'<>]{4,}""")
ADDED = ("parts", "n_assign", "n_access", "n_hex", "base_spans", "spans")
_LIST = "array<struct<kind:int,start:int,end:int>>"


def parts_of(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of base findings and weak parts of one text, in code points."""
    out = []
    if "=" in text or ":" in text:
        low = text.lower() if text.isascii() else text
        if any(k in low for k in ("password", "passwd", "secret", "token", "api", "key")) or low is text:
            for m in _ASSIGN.finditer(text):
                n = m.end(2) - m.start(2)
                out.append((0 if n >= _ASSIGN_LEAST else 4, m.start(), m.end()))
        out += [(3, *m.span()) for m in _IDENTIFIER.finditer(text)]
        if "://" in text:
            out += [(5, *m.span()) for m in _ENDPOINT.finditer(text)]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _ACCESS_LEAST]
    out += [(2, *m.span()) for m in _HEX.finditer(text)]
    out += [(4, *m.span()) for m in _BLOB.finditer(text)]
    return out


def find_parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``parts``: kind (index into KINDS), start and end."""
    fields = [f for f in docs.schema.fields if f.name != "parts"]
    docs = docs.select(*["`" + f.name.replace("`", "``") + "`" for f in fields])
    kind = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end")]))
    arrow = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches):
        for whole in batches:
            for batch in _tokens.text_slices(whole, text):
                found = [[{"kind": k, "start": s, "end": e} for k, s, e in parts_of(t or "")]
                         for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)],
                                                 [*batch.schema.names, "parts"])

    return docs.mapInArrow(scan, T.StructType([*fields, T.StructField("parts", kind)]))


def linked_parts(rows: DataFrame, keys: list[str], reach: int = REACH) -> DataFrame:
    """(keys, linked): the weak parts of each document that have a complement near.

    ``rows`` has the keys (without nulls) and ``parts``. Both sides are laid on stretches of
    ``reach`` code points, so a join key holds the parts of one stretch: few, as parts of
    one kind do not overlap and have least lengths, however many a document has.
    """
    part = rows.select(*keys, F.inline("parts")).distinct()
    secret = F.col("kind").isin(0, 2, 4)
    stretch = lambda a, b: F.explode(F.sequence(F.floor(a / reach), F.floor(b / reach))).alias("stretch")
    left = part.where(secret).select(*keys, stretch(F.col("start"), F.col("end")), F.struct("kind", "start", "end").alias("s"))
    right = part.where(~secret).select(
        *keys, stretch(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach),
        F.struct("kind", "start", "end").alias("o"))
    gap = F.greatest(F.col("s.start") - F.col("o.end"), F.col("o.start") - F.col("s.end"))
    near = left.join(right, [*keys, "stretch"]).where(gap <= reach)
    weak = near.select(*keys, F.explode(F.array("s", "o")).alias("p")).where("p.kind >= 3").distinct()
    return weak.groupBy(*keys).agg(F.sort_array(F.collect_list("p")).alias("linked"))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """All rows and columns of ``docs`` with n_assign, n_access, n_hex, base_spans and
    spans (arrays of kind, start, end, sorted by start, then kind).

    Null text counts as empty; repeated rows and null ids each get their own result; whole
    texts are scanned; columns named like the results are replaced; no rows give none.
    """
    docs = docs.drop(*ADDED)
    found = find_parts(docs, text)
    # equal texts under equal ids have equal parts, so they may share a key
    own, told, own_too, told_too, linked_as = free(found, "__id", "__mark", "__i", "__m", "linked")
    mark = {own: F.coalesce(F.col(doc_id).cast("string"), F.lit("")), told: F.xxhash64(text, F.lit(1))}
    weak = F.exists("parts", lambda p: p["kind"] >= 3)
    # the texts are read once for their weak parts, which are linked from a written table, and once below
    some = keep(found.where(weak).select(*[v.alias(k) for k, v in mark.items()], "parts"), "weak")
    linked = keep(linked_parts(some, list(mark), reach).withColumnsRenamed({own: own_too, told: told_too, "linked": linked_as}), "linked")
    if linked.limit(SENT_ROWS + 1).count() <= SENT_ROWS:
        linked = F.broadcast(linked)  # else both sides are shuffled
    with_links = found.withColumns(mark).join(
        linked, F.when(weak, F.col(own)).eqNullSafe(F.col(own_too)) & (F.col(told) == F.col(told_too)), "left")
    base = F.filter("parts", lambda p: p["kind"] < 3)
    order = lambda x: F.transform(F.array_sort(F.transform(x, lambda p: F.struct(
        p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))), lambda p: F.struct(
            p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    count = lambda k: F.size(F.filter("parts", lambda p: p["kind"] == k)).cast("bigint")
    nothing = F.array().cast(_LIST)
    return with_links.withColumns({
        "n_assign": count(0), "n_access": count(1), "n_hex": count(2), "base_spans": order(base),
        "spans": order(F.concat(base, F.coalesce(F.col(linked_as), nothing)))}).drop("parts", linked_as, own, told, own_too, told_too)


def listed(spans: str):
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", names[p["kind"]], p["start"], p["end"])), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The rows of ``docs`` with every reported span of ``text`` replaced by ``mask``."""
    columns = docs.columns
    aside = {c: f"__in_{c}" for c in columns if c in ADDED}
    found = scan_secrets(docs.withColumnsRenamed(aside), doc_id, text)
    body = F.col("`" + text.replace("`", "``") + "`")
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def step(state, p):
        fresh = p["start"] >= state["at"]
        piece = F.concat(state["done"], F.substring(body, state["at"] + 1, F.greatest(p["start"] - state["at"], F.lit(0))),
                         F.when(fresh, F.lit(mask)).otherwise(""))
        return F.struct(piece.alias("done"), F.greatest(state["at"], p["end"]).alias("at"))

    clean = F.aggregate("spans", start, step, lambda s: F.concat(s["done"], F.substring(body, s["at"] + 1, F.length(body))))
    return found.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(body)).select(
        *[F.col("`" + aside.get(c, c).replace("`", "``") + "`").alias(c) for c in columns])
