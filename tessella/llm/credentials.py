"""Secrets in texts, and weak candidates that complementary parts nearby confirm.

Strong matches (``BASE``) always count. Weak candidates are parts of a credential: an access
identifier such as a user's name or e-mail address, a secret, or an endpoint such as a URL or address. By itself each is as likely a harmless word, so one is
reported only if the parts that complete it stand in its scope: within REACH code points, without a
blank line between. Parts meet in an interval join of scopes and spans over (document, bin).
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "endpoint", "weak_access", "weak_secret")
BASE = KINDS[:3]
#: The part of a credential that each kind is.
PART = {"assign": "secret", "hex": "secret", "weak_secret": "secret", "access": "access", "weak_access": "access", "endpoint": "endpoint"}
REACH, BIN = 200, 256

_EITHER_CASE = re.ASCII | re.IGNORECASE
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _EITHER_CASE)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_ENDPOINT = re.compile(r"(?:https?|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqp|ftp|ssh)://[^\s\"'<>]+|\b(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?\b(?!\.\d)", _EITHER_CASE)
#: What every address has.
_DOTTED = re.compile(r"\.\d{1,3}\.\d{1,3}\.\d")
#: Where a label begins: behind no letter, or at a change of case as in dbUser.
_LABEL = r"(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))"
_WEAK_ACCESS = re.compile(_LABEL + r"""(?:(?<!secret)(?<!secret_)access_?key(?:_?id)?|client_?id|account(?:_?id)?|user(?:_?name|_?id)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,64}""", _EITHER_CASE)
_WEAK_ACCESS_WORDS = ("access", "client", "account", "user", "login")
_WEAK_LABELLED = re.compile(_LABEL + r"""(?:secret_?access_?key|pass|pwd|key|auth|credentials?|private_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}""", _EITHER_CASE)
_WEAK_LABELLED_WORDS = ("pass", "pwd", "key", "auth", "credential")
_WEAK_BARE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_URL_BARE = re.compile(r"[A-Za-z0-9+_=-]{20,}")
_AFTER_HOST, _USER = re.compile(r"[/?#;]"), re.compile(r"([^:@]*)(?::([^@]*))?@")
_MIXED = (re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]"))
_BLANK_LINE = re.compile(r"\n[\x20\x09\x0B-\x0D]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strong matches of a whole text, in order of start and kind."""
    low, found = text.lower(), []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def weak_spans(text: str, strong: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the weak candidates, none of which overlaps a strong match or another one.

    Where candidates overlap, the kind that comes first in KINDS takes the place, but for the parts in
    a URL: name and password before its host are parts, and it ends before the first part behind its host.
    """
    low = text.lower()
    access = [m.span() + ("weak_access",) for m in _WEAK_ACCESS.finditer(text)] if any(w in low for w in _WEAK_ACCESS_WORDS) else []
    access += [m.span() + ("weak_access",) for m in _EMAIL.finditer(text)] if "@" in text else []
    labelled = [m.span() + ("weak_secret",) for m in _WEAK_LABELLED.finditer(text)] if any(w in low for w in _WEAK_LABELLED_WORDS) else []
    # values that were too short for a strong match are weak ones
    labelled += [m.span() + ("weak_secret",) for m in _ASSIGN.finditer(text) if 4 <= len(m[2]) < 8] if any(w in low for w in _ASSIGN_WORDS) else []
    bare = [m.span() + ("weak_secret",) for m in _WEAK_BARE.finditer(text) if all(c.search(m[0]) for c in _MIXED)]
    endpoints, parts = [], sorted([*strong, *access, *labelled])
    for m in _ENDPOINT.finditer(text) if "://" in text or _DOTTED.search(text) else ():
        start, end = m.span()
        if "://" in m[0]:
            host = text.index("://", start) + 3
            behind = _AFTER_HOST.search(text, host, end)
            tail = behind.start() if behind else end
            named = _USER.match(text, host, tail)
            in_url = [(s, e, "weak_secret") for s, e in (x.span() for x in _URL_BARE.finditer(text, tail, end) if all(c.search(x[0]) for c in _MIXED))]
            at = bisect_right(parts, (tail,))
            first = [parts[at][0]] if at < len(parts) and parts[at][0] < end else []
            end = min([end, *first, *[s for s, _, _ in in_url]])
            bare += in_url
            if named:
                start = named.end()
                access += [(*named.span(1), "weak_access")] if named[1] else []
                labelled += [(*named.span(2), "weak_secret")] if named[2] else []
            while end < m.end() and end > start and text[end - 1] in "?&;#":
                end -= 1
        if start < end:
            endpoints.append((start, end, "endpoint"))
    lists = [endpoints, sorted(access), sorted(labelled), sorted(bare)]
    taken: list[tuple[int, int, str]] = []
    for end, start, kind in sorted((e, s, k) for s, e, k in strong):  # strong spans may overlap: a union for the test below
        if taken and start <= taken[-1][1]:
            first = min(start, taken[-1][0])
            while len(taken) > 1 and first <= taken[-2][1]:
                first = min(first, taken.pop()[0], taken[-1][0])
            taken[-1] = (first, max(end, taken[-1][1]), kind)
        else:
            taken.append((start, end, kind))
    found: list[tuple[int, int, str]] = []
    for spans in filter(None, lists):
        starts = [s for s, _, _ in taken]
        fresh, last = [], -1
        for s, e, k in spans:
            at = bisect_right(starts, s)
            clear = (not at or taken[at - 1][1] <= s) and (at == len(taken) or taken[at][0] >= e) and s >= last
            if clear:
                fresh.append((s, e, k))
                last = e
        found += fresh
        taken = sorted(taken + fresh)
    return sorted(found)


def scopes(text: str, spans: list[tuple[int, int, str]], reach: int = REACH) -> list[tuple[int, int]]:
    """Where the parts that complete each span may stand: up to ``reach`` away, in its paragraph."""
    cuts = [0, *(m.end() for m in _BLANK_LINE.finditer(text)), len(text) + 1]
    found = []
    for start, end, _ in spans:
        low, high = cuts[bisect_right(cuts, start) - 1], cuts[bisect_right(cuts, max(start, end - 1))]
        found.append((max(low, start - reach), min(high, end + reach)))
    return found


def completed(kind: str, access: bool, secret: bool) -> bool:
    """The rule: an identifier needs a secret, a secret an identifier, an endpoint both."""
    return {"weak_access": secret, "weak_secret": access, "endpoint": access and secret}[kind]


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(id, digest, base array<span>, weak array<candidate>) of every row, by whole texts.

    Spans are start, end and kind in code points; a weak candidate also has the scope's start and end.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    span = [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]
    base_type, weak_type = pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("low", pa.int64()), ("high", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            base, weak = [], []
            for text in batch.column(2).to_pylist():
                strong = base_spans(text)
                more = weak_spans(text, strong)
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in strong])
                weak.append([{"start": s, "end": e, "kind": k, "low": a, "high": b} for (s, e, k), (a, b) in zip(more, scopes(text, more, reach) if more else ())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(base, base_type), pa.array(weak, weak_type)], ["id", "digest", "base", "weak"])

    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return rows.mapInArrow(find, f"id {id_type}, digest long, base array<struct<start: bigint, end: bigint, kind: string>>, weak array<struct<start: bigint, end: bigint, kind: string, low: bigint, high: bigint>>")


def link_parts(found: DataFrame) -> DataFrame:
    """(id, digest, linked array<span>): the weak candidates whose scope holds what completes them.

    An interval join: a scope and a span meet in the bins of the text that both touch. A bin holds no
    more parts than it has code points, so neither a long text nor a frequent one makes a hot key,
    and rows that repeat id and text are joined once.
    """
    once = found.where(F.size("weak") > 0).dropDuplicates(["id", "digest"])
    weak = F.explode("weak").alias("w")
    part = F.when(F.col("s.kind").isin(*[k for k, p in PART.items() if p == "secret"]), "secret").when(F.col("s.kind").isin("access", "weak_access"), "access")
    plain = F.transform("weak", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    spans = once.select("id", "digest", F.explode(F.concat("base", plain)).alias("s")).select("id", "digest", "s.start", "s.end", part.alias("part")).where("part IS NOT NULL")
    spans = spans.withColumn("bin", F.explode(F.expr(f"sequence(start DIV {BIN}, (end - 1) DIV {BIN})"))).select(F.col("id").alias("part_id"), F.col("digest").alias("part_digest"), F.col("start").alias("part_start"), F.col("end").alias("part_end"), "part", F.col("bin").alias("part_bin"))
    wanted = once.select("id", "digest", weak).select("id", "digest", "w.*").withColumn("bin", F.explode(F.expr(f"sequence(low DIV {BIN}, (high - 1) DIV {BIN})")))
    meets = F.col("id").eqNullSafe(F.col("part_id")) & (F.col("digest") == F.col("part_digest")) & (F.col("bin") == F.col("part_bin")) & (F.col("part_start") < F.col("high")) & (F.col("part_end") > F.col("low"))
    key = ["id", "digest", "start", "end", "kind"]
    parts = wanted.join(spans, meets).groupBy(*key).agg(F.max(F.col("part") == "access").alias("access"), F.max(F.col("part") == "secret").alias("secret"))
    rule = F.when(F.col("kind") == "weak_access", F.col("secret")).when(F.col("kind") == "weak_secret", F.col("access")).otherwise(F.col("access") & F.col("secret"))
    return parts.where(rule).groupBy("id", "digest").agg(F.collect_list(F.struct("start", "end", "kind")).alias("linked"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(id, base array<span>, linked array<span>) of every row.

    ``base`` has the strong matches and ``linked`` the weak candidates that complementary parts in
    their scope confirm, both in order of start and kind. Null and empty texts have neither. Repeated
    rows stay, with equal results; null ids are ids like any other. Other columns are not read; an
    empty table gives an empty result.
    """
    found = materialise(find_candidates(docs, id_col, text_col, reach), "candidates")
    linked = link_parts(found).withColumnsRenamed({"id": "linked_id", "digest": "linked_digest"})
    same = F.col("id").eqNullSafe(F.col("linked_id")) & (F.col("digest") == F.col("linked_digest"))
    none = F.array().cast("array<struct<start: bigint, end: bigint, kind: string>>")
    out = found.join(linked, same, "left")
    return out.select("id", "base", in_order(F.coalesce("linked", none)).alias("linked"))


def in_order(spans):
    """An array of spans by start and then by kind as listed in KINDS."""
    rank = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    keyed = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.transform(keyed, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
