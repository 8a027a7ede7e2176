"""Secret scans: keywords by Aho-Corasick, regular expressions anchored at the hits, then embedded checksums.

One pass of an Aho-Corasick automaton over the text, A-Z lower-cased, finds the keywords. Only there is a kind's regular
expression tried, anchored at the place that the keyword fixes; a kind's matches are taken leftmost first and don't
overlap, as an ordinary search would give them. Runs of hexadecimal digits have no keyword; since a run of 32 has one at
any place, all strings of four such digits are keywords, and a hit is widened to its run.

Kinds with an embedded checksum count only where it holds: it tells real keys from look-alikes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ships_by_value

ships_by_value(__name__)

#: In this order at equal starts. The base kinds come first.
KINDS = ("assign", "access", "hex", "github", "npm", "grafana")
#: Keywords that start a match.
WORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",), "grafana": ("glsa_",)}
#: What has to follow.
PATTERNS = {
    "assign": r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"(AKIA[A-Z0-9]+)",
    "github": r"(gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "npm": r"(npm_[A-Za-z0-9]{36})(?![A-Za-z0-9])",
    "grafana": r"(glsa_[A-Za-z0-9]{32}_[0-9a-fA-F]{8})(?![A-Za-z0-9])",
}
LEAST = {"assign": 8, "access": 16, "hex": 32}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out.rjust(width, "0")


def checksum_holds(kind: str, found: str) -> bool:
    """CRC-32 of a key's body, at its end: six base-62 digits (github, npm) or eight hexadecimal ones (grafana)."""
    from zlib import crc32

    if kind == "grafana":
        body, _, end = found.rpartition("_")
        return crc32(body.encode()) == int(end, 16)
    body = found.split("_", 1)[1]
    return base62(crc32(body[:-6].encode()), 6) == body[-6:]


def scanner():
    """A function from a text to its spans (kind, start, end) in code points, ordered by start, then kind."""
    import re
    from itertools import product

    import ahocorasick

    finder = ahocorasick.Automaton()
    for kind, words in WORDS.items():
        for w in words:
            finder.add_word(w, (kind, len(w)))
    for four in product("0123456789abcdef", repeat=4):
        finder.add_word("".join(four), ("hex", 4))
    finder.make_automaton()
    compiled = {k: re.compile(p) for k, p in PATTERNS.items()}
    run = re.compile("[0-9a-f]+")
    order = {k: n for n, k in enumerate(KINDS)}

    def scan(text: str) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        over = dict.fromkeys(KINDS, 0)
        # bytes.lower() turns A-Z only, so that no place moves
        low = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        for last, (kind, size) in finder.iter(low):
            start = last - size + 1
            if start < over[kind]:
                continue
            if kind == "hex":
                # the first hit of a run need not be at its start: upper-case digits are lower-cased here only
                m = run.match(text, start)
                if not m:
                    continue
                while start > over[kind] and text[start - 1] in "0123456789abcdef":
                    start -= 1
                end = m.end()
                over[kind] = end
                if end - start >= LEAST[kind]:
                    out.append((kind, start, end))
                continue
            m = compiled[kind].match(text, start)
            if not m:
                continue
            if kind in LEAST:
                over[kind] = m.end()
                if len(m[1]) >= LEAST[kind]:
                    out.append((kind, m.start(), m.end()))
            elif checksum_holds(kind, m[1]):
                over[kind] = m.end()
                out.append((kind, m.start(), m.end()))
        return sorted(out, key=lambda x: (x[1], order[x[0]]))

    return scan


def scan_docs(docs: DataFrame) -> DataFrame:
    """doc_id, spans (array of kind, start, end; code points, end exclusive) of each row of docs.

    Null text: no spans. Other columns are ignored, rows may repeat, empty docs give an empty result. Texts of any length
    are scanned whole.
    """

    def rows(batches):
        import pyarrow as pa

        scan = scanner()
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end"), x)) for x in scan(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, span)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")
