"""Personal data found from anchors: cues located at once, boundaries by small local parsers.

One Aho-Corasick automaton finds every at-sign, a digit after a dot or a plus, digits, schemes
and identifier cues. Each hit goes to the parser of its kind, which reads outwards from the
anchor to the boundaries of the match, validates it, and says where the next match of its kind
may begin; hits before that place are passed over, so a text is read about once whatever it holds.

Base kinds are the leftmost non-overlapping matches of fixed patterns:
email, ip (four parts of at most 255), card (13 to 19 digits by Luhn) and phone (9 to 15 digits).
The anchors add iban (by country, length and remainder 97), account (a number after a word for
one) and uri (an address that names a person: with user part, or of a mail or call scheme).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorrel.llm.common import id_text, texts_of

#: Kinds in the order of results.
BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "account", "uri")
KINDS = BASE + ADDED

# fixed values: lengths of account numbers by country, words before account numbers, schemes
_IBAN = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27,
         "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24}
_CUES = ("account", "acct", "konto", "kontonummer", "cuenta", "compte", "passport", "ssn")
_SCHEMES = ("mailto:", "tel:", "sip:", "sips:")

_DIGITS = frozenset("0123456789")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"(?:\.[0-9]+)+")
_DIGIT_RUN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE_RUN = re.compile(r"[ ().0-9-]*")
_AFTER_CUE = re.compile(r"(?:[ \t]*(?:number|no\.?|nr\.?|#))?[ \t]*[:=#]?[ \t]*([A-Za-z0-9]+(?:[ -]?[0-9]+)*)(?![A-Za-z0-9])", re.I)
_URI_REST = re.compile(r"[^\s<>\"{}|\\^`]*")
_WORD = re.compile(r"[A-Za-z0-9]")
_SCHEME_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")


def _automaton() -> ahocorasick.Automaton:
    cues: dict[str, tuple[str, int]] = {"@": ("email", 1), "://": ("uri", 3)}
    for d in "0123456789":
        cues |= {d: ("card", 1), f".{d}": ("ip", 2), f"+{d}": ("phone", 2)}
    cues |= {f"{c}{d}": ("iban", 3) for c in _IBAN for d in "0123456789"}
    for word in _CUES:
        cues |= {w: ("account", len(w)) for w in (word, word.upper(), word.capitalize())}
    for word in _SCHEMES:
        cues |= {w: ("uri", len(w)) for w in (word, word.upper())}
    out = ahocorasick.Automaton()
    for cue, value in cues.items():
        out.add_word(cue, value)
    out.make_automaton()
    return out


_AUTOMATON = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _email(text: str, at: int, free: int) -> tuple[list, int]:
    start = at
    while start > free and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return ([(start, domain.end())], domain.end()) if domain else ([], free)


def _ip(text: str, at: int, free: int) -> tuple[list, int]:
    """All groups of four in the chain of dotted numbers around the dot at ``at``."""
    start = at
    while start > free and text[start - 1] in _DIGITS:
        start -= 1
    if start == at:
        return [], free
    end = _DOTTED.match(text, at).end()
    parts, place, found = text[start:end].split("."), start, []
    for i in range(0, len(parts) - 3, 4):
        four = parts[i:i + 4]
        stop = place + sum(map(len, four)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
            found.append((place, stop))
        place = stop + 1
    return found, end


def _card(text: str, at: int, free: int) -> tuple[list, int]:
    end = _DIGIT_RUN.match(text, at).end()
    if end - at < 13:
        return [], end
    digits = text[at:end].replace(" ", "").replace("-", "")
    return ([(at, end)] if 13 <= len(digits) <= 19 and luhn(digits) else []), end


def _phone(text: str, at: int, free: int) -> tuple[list, int]:
    run = _PHONE_RUN.match(text, at + 2).group().rstrip(" ().-")
    if len(run) < 2:
        return [], at + 2
    end = at + 2 + len(run)
    return ([(at, end)] if 9 <= 1 + sum(c in _DIGITS for c in run) <= 15 else []), end


def _iban(text: str, at: int, free: int) -> tuple[list, int]:
    if at and _WORD.match(text, at - 1):
        return [], free
    wanted, end, got = _IBAN[text[at:at + 2]], at, []
    while end < len(text) and len(got) < wanted:
        c = text[end]
        if c.isascii() and (c.isdigit() or c.isupper()):
            got.append(c)
        elif c != " " or len(got) % 4 or text[end - 1] == " ":
            break
        end += 1
    if len(got) < wanted or end < len(text) and _WORD.match(text, end):
        return [], free
    turned = "".join(got[4:] + got[:4])
    return ([(at, end)], end) if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 else ([], free)


def _account(text: str, at: int, free: int, length: int) -> tuple[list, int]:
    if at and _WORD.match(text, at - 1):
        return [], free
    found = _AFTER_CUE.match(text, at + length, at + length + 64)
    if not found or _WORD.match(text, at + length):
        return [], free
    number = found.group(1)
    if not 6 <= sum(c in _DIGITS for c in number) <= 20 or len(number) > 34:
        return [], free
    return [found.span(1)], found.end(1)


def _uri(text: str, at: int, free: int, length: int) -> tuple[list, int]:
    end = _URI_REST.match(text, at + length).end()
    while end > at + length and text[end - 1] in ".,;:!?)]'":
        end -= 1
    start, body = at, text[at + length:end]
    if text.startswith("://", at):
        while start > free and text[start - 1] in _SCHEME_LEFT:
            start -= 1
        user, sign, host = re.split(r"[/?#]", body, maxsplit=1)[0].rpartition("@")
        good = start < at and text[start].isalpha() and bool(sign and user and host)
    elif text[at:at + 3].lower() == "tel":
        good = 6 <= sum(c in _DIGITS for c in body) <= 15 and not set(body) - set("+0123456789().-")
    else:
        name, sign, host = body.partition("@")
        good = bool(name and sign) and bool(_DOMAIN.match(host))
    if not good or start and start == at and _WORD.match(text, start - 1):
        return [], max(free, end)
    return [(start, end)], end


_PARSERS = {"email": _email, "ip": _ip, "card": _card, "phone": _phone, "iban": _iban}
_LONGER = {"account": _account, "uri": _uri}


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by kind as in ``KINDS``, then start."""
    found: dict[str, list] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)
    for last, (kind, length) in _AUTOMATON.iter(text or ""):
        at = last - length + 1
        if at < free[kind]:
            continue
        got, free[kind] = _PARSERS[kind](text, at, free[kind]) if kind in _PARSERS else _LONGER[kind](text, at, free[kind], length)
        found[kind] += got
    return [(k, s, e) for k in KINDS for s, e in found[k]]


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) per row of ``docs``; spans is an array of (kind, start, end), empty where there is none.

    Null text counts as empty. Null and repeated ids keep a row each. Other columns play no part.
    """
    base = id_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in spans(text)] for text in texts_of(batch)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.record_batch([batch.column(0), pa.array(found, kind)], [id_col, "spans"])

    return base.mapInArrow(run, T.StructType([T.StructField(id_col, base.schema["_id"].dataType), T.StructField("spans", _SPAN)]))


def masked(docs: DataFrame, kinds: tuple[str, ...] = KINDS, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``kinds`` replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, place = [], 0
        for start, end, kind in sorted((s, e, k) for k, s, e in spans(text) if k in kinds):
            if start >= place:
                out += [text[place:start], f"<{kind}>"]
            place = max(place, end)
        return "".join([*out, text[place:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array([clean(t) for t in texts_of(batch, text_col)], batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and digest of the base kinds, all spans as text."""
    found = scan(docs, id_col, text_col)
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = joined(of(*BASE))
    return found.select(id_col, *counts, F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
