"""Secret scans with linking of credentials that come in several parts.

Strong patterns (``assign``, ``access``, ``hex``) are reported wherever they
stand.  Three weak kinds are reported only next to their complements:

* ``id``        an access, client or account identifier given by name,
                or a key id with a known prefix that is too short for ``access``;
* ``secret``    a token of 20 or more characters mixing cases and digits;
* ``endpoint``  a URL, a host with a port, or an IPv4 address.

Every part opens a scope: ``REACH`` code points before and after it in the same
text; a part is in it if any of its characters is.  Parts and scopes are
interval-joined in Spark (equi-join on document and every bin of ``REACH`` code
points that they touch, then the exact distance).  A weak id counts with
a secret in its scope (``assign``, ``hex`` or ``secret``); a weak secret with
an identifier (``access`` or ``id``); an endpoint with both.  A scope holds a
bounded number of parts, as parts of a kind do not overlap, so the join grows
with the number of parts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import text_udf
from concord.session import materialize

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
REACH = 200
MASK = "[SECRET]"
#: Fixed values of the strong kinds: pattern, and the length its (last) group must have.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")
_ASSIGN_WORDS = ("passw", "secret", "token", "api_key", "apikey")

_ID = re.compile(r"""(?:access|client|account|user|tenant)[_-]?(?:key[_-]?)?id["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{6,}"""
                 r"""|(?-i:\b(?:AKIA|ASIA|AIDA|AROA)[A-Z0-9]{4,})""", re.I | re.A)
_ID_WORDS = ("id", "akia", "asia", "aida", "aroa")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_ENDPOINT = re.compile(r"""[a-z][a-z0-9+]{1,9}://[^\s"'<>]{4,}|\b\d{1,3}(?:\.\d{1,3}){3}(?::\d{2,5})?\b""", re.A)
#: A whole run of host characters with a port behind it (tried once a run, so in linear time), and where a name may begin in it.
_HOST_RUN = re.compile(r"(?<![a-z0-9.-])[a-z0-9.-]++(?=:\d{2,5}\b)", re.A)
_HOST_START = re.compile(r"\b[a-z0-9-]", re.A)
_PORT = re.compile(r":\d{2,5}", re.A)
_PART = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
PARTS = "array<struct<kind: int, start: bigint, end: bigint>>"


def strong_parts(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strong kinds."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def weak_parts(text: str, strong: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the weak kinds that overlap no strong part."""
    out = []
    if any(w in text.lower() for w in _ID_WORDS) and (":" in text or "=" in text or "A" in text):
        out += [(3, m.start(), m.end()) for m in _ID.finditer(text)]
    for m in _TOKEN.finditer(text):
        t = m[0]
        if any(c.isdigit() for c in t) and t.lower() != t and t.upper() != t:
            out.append((4, m.start(), m.end()))
    if "." in text or "://" in text:
        out += _endpoints(text)
    return _apart(out, [(s, e) for _, s, e in strong])


def _endpoints(text: str) -> list[tuple[int, int, int]]:
    """URLs and IPv4 addresses, and apart from them hosts of two or more labels with a port."""
    found = [(5, m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    hosts = []
    for m in _HOST_RUN.finditer(text):
        a, b = max(m.start(), hosts[-1][2] if hosts else 0), m.end()
        # the last labels without an empty one among them
        if (gap := text.rfind("..", a, b)) >= 0:
            a = gap + 2
        head = _HOST_START.search(text, a + text.startswith(".", a), b)
        if head and text[b - 1] != "." and "." in text[head.start(): b]:
            hosts.append((5, head.start(), _PORT.match(text, b).end()))
    return found + _apart(hosts, [(s, e) for _, s, e in found])


def _apart(parts: list[tuple[int, int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The parts that overlap none of the spans."""
    spans = sorted(spans)
    starts = [s for s, _ in spans]
    reach = list(accumulate((e for _, e in spans), max))           # the farthest end up to each span
    return [p for p in parts if not (k := bisect_left(starts, p[2])) or reach[k - 1] <= p[1]]


def _scan(texts: pa.Array) -> pa.Array:
    rows = []
    for t in texts.to_pylist():
        strong = strong_parts(t or "")
        rows.append([{"kind": k, "start": s, "end": e} for k, s, e in strong + weak_parts(t or "", strong)])
    return pa.array(rows, _PART)


def _row_key() -> Column:
    """Tells rows with one doc_id and different texts apart (equal rows have equal spans)."""
    return F.xxhash64("doc_id", "text")


def linked_parts(scanned: DataFrame, reach: int = REACH) -> DataFrame:
    """scanned(doc_id, row_key, parts) -> (doc_id, row_key, linked array of parts):
    the weak parts that have their complements in scope, for rows that have any."""
    rows = scanned.where(F.exists("parts", lambda p: p["kind"] >= 3) & (F.size("parts") > 1)) \
        .select("doc_id", "row_key", F.explode("parts").alias("p")).select("doc_id", "row_key", "p.*").distinct()
    bins = lambda lo, hi: F.explode(F.sequence(F.call_function("div", lo, F.lit(reach)),     # noqa: E731
                                               F.call_function("div", hi, F.lit(reach)))).alias("bin")
    scopes = rows.where("kind >= 3").select(
        "doc_id", "row_key", "kind", "start", "end", bins(F.greatest(F.col("start") - reach, F.lit(0)), F.col("end") + reach))
    parts = rows.select(F.col("doc_id").alias("d"), F.col("row_key").alias("k"), F.col("kind").alias("kind2"),
                        F.col("start").alias("start2"), F.col("end").alias("end2"),
                        bins(F.col("start"), F.col("end") - 1))
    near = (F.col("start2") < F.col("end") + reach) & (F.col("end2") > F.col("start") - reach)
    met = scopes.join(parts, scopes.doc_id.eqNullSafe(parts.d) & (scopes.row_key == parts.k)
                      & (scopes.bin == parts.bin) & near)
    has = lambda *kinds: F.max(F.col("kind2").isin(*kinds))                                  # noqa: E731
    found = met.groupBy("doc_id", "row_key", "kind", "start", "end").agg(
        has(0, 2, 4).alias("with_secret"), has(1, 3).alias("with_id"))
    good = F.when(F.col("kind") == 3, F.col("with_secret")).when(F.col("kind") == 4, F.col("with_id")).otherwise(
        F.col("with_secret") & F.col("with_id"))
    return found.where(good).groupBy("doc_id", "row_key").agg(
        F.collect_list(F.struct("kind", "start", "end")).alias("linked"))


def find_secrets(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, row_key, strong, spans): arrays of (kind, start, end)
    in code points, by start, then kind; ``spans`` has the linked weak parts too.

    Null and empty texts have empty arrays; every row of the input gives a row
    (repeated rows equal ones), an empty table none.  Texts are scanned in time in
    proportion to their length, however they repeat.  ``row_key`` is ``_row_key``
    of the row."""
    scanned = materialize(docs.select("doc_id", _row_key().alias("row_key"), text_udf(_scan, PARTS)("text").alias("parts")),
                          "secret-parts")
    linked = linked_parts(scanned, reach)
    order = lambda parts: F.transform(F.array_sort(F.transform(parts, lambda p: F.struct(      # noqa: E731
        p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))),
        lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    strong = F.filter("parts", lambda p: p["kind"] < 3)
    weak = F.coalesce(F.col("linked"), F.array().cast(PARTS))
    l2 = linked.withColumnsRenamed({"doc_id": "d", "row_key": "k"})
    return (scanned.join(l2, scanned.doc_id.eqNullSafe(l2.d) & (scanned.row_key == l2.k), "left")
            .select("doc_id", "row_key", order(strong).alias("strong"), order(F.concat(strong, weak)).alias("spans")))


def spans_text(parts: Column) -> Column:
    """kind:start:end of each part, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(
        ":", names[p["kind"]], p["start"].cast("string"), p["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """One row a document: counts of the strong kinds, their digest, and all spans."""
    count = lambda k: F.size(F.filter("strong", lambda p: p["kind"] == k)).cast("bigint")      # noqa: E731
    return find_secrets(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("strong")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def masked(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with every maximal run of overlapping spans (by start) replaced by ``MASK``."""
    out, at = [], 0
    for start, end in spans:
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def _masked_texts(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """``masked`` for rows with a text and spans (kind, start, end); null for others."""
    return pa.array([None if t is None or not p else masked(t, [(x["start"], x["end"]) for x in p])
                     for t, p in zip(texts.to_pylist(), spans.to_pylist())], pa.string())


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with masked texts; all rows and columns stay (a null text stays null)."""
    found = find_secrets(docs.select("doc_id", "text")).where(F.size("spans") > 0).select(
        F.col("doc_id").alias("__doc"), F.col("row_key").alias("__key"), F.col("spans").alias("__spans")).distinct()
    keyed = docs.withColumn("__row", _row_key())
    met = keyed.join(found, keyed.doc_id.eqNullSafe(F.col("__doc")) & (F.col("__row") == F.col("__key")), "left")
    # only texts with spans go to the Python worker
    sent = F.when(F.col("__spans").isNotNull(), F.col("text"))
    return met.withColumn("text", F.coalesce(F.arrow_udf(_masked_texts, "string")(sent, F.col("__spans")), F.col("text"))).drop("__doc", "__key", "__spans", "__row")
