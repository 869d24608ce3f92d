"""Replacement of personal data by keyed surrogates of the same kind.

Entities are found by pattern (mail addresses, telephone and card numbers, network addresses, keys and secrets) and by name (a given
name from a list, or a form of address, before capitalised words). Each is reduced to a canonical form, and each canonical form gets one surrogate, drawn
from a keyed digest: the same person, address or number is replaced alike in every document, and nothing can be traced back
without the key. Surrogates keep format, script, letter case and, for names, gender; card numbers keep a valid check digit.

Distinct entities must stay distinct, and a surrogate must not be somebody else's real data. Both are checked over the whole
corpus: of entities whose surrogates collide, all but the least, and any whose surrogate is a real entity, draw again until
no collision is left. Drawing again is rare, so documents are scanned twice and only those that mention such an
entity are joined with what it became; texts are not shuffled for the rest unless these exceptions outgrow Spark's own limit for broadcasts.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm.shared import packed, text_key
from kinfold.session import checkpoint, checkpoint_counting

#: Given names by script and gender; a name's surrogate is another of its list.
NAMES = {
    ("latin", "f"): "anna maria julia laura sarah emma elena claire sophie carmen lucia ingrid katharina charlotte camille pilar",
    ("latin", "m"): "peter thomas martin david james robert carlos miguel antonio pierre jacques hans stefan michael daniel andreas",
    ("cyrillic", "f"): "анна мария ольга елена наталья татьяна ирина светлана",
    ("cyrillic", "m"): "иван пётр алексей дмитрий сергей андрей николай михаил",
    ("greek", "f"): "μαρία ελένη αικατερίνη βασιλική σοφία αγγελική",
    ("greek", "m"): "γεώργιος δημήτριος κωνσταντίνος ιωάννης νικόλαος χρήστος",
}
#: Forms of address and the gender they tell.
TITLES = {"mr": "m", "mrs": "f", "ms": "f", "dr": "", "prof": "", "herr": "m", "frau": "f", "monsieur": "m", "madame": "f", "señor": "m", "señora": "f"}
GIVEN = {n: kind for kind, names in NAMES.items() for n in names.split()}
SYLLABLES = {
    "latin": "ba be do fa ga hel ka lan lo mar me nor pa ran ro sen ta tor vi wal".split(),
    "cyrillic": "ба ве го да зо ка ла ми но па ра се то ва ро мо".split(),
    "greek": "βα γε δο κα λα μι νο πα ρο σε το φα".split(),
}
SCRIPTS = (("cyrillic", re.compile("[Ѐ-ӿ]")), ("greek", re.compile("[Ͱ-Ͽἀ-῿]")))

#: Words before a secret, in lower case.
CUES = ("password", "token", "secret", "api_key")
PATTERNS = (
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")),
    # what follows a cue is only looked at, so that a cue within it is seen too
    ("secret", re.compile(rf"(?ai:{'|'.join(CUES)})[\"']?[ \t]*[:=][ \t]*[\"']?(?=([^\s\"',;]{{6,}}))|\bAKIA[0-9A-Z]{{16}}\b")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("card", re.compile(r"(?<![\d-])(?:\d{4}[ -]?){3}\d{1,7}(?![\d-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<!\w)\+\d{8,15}(?!\d)"
                         # in pairs; ten digits on end, but for those that begin like a time in seconds
                         r"|(?<![\w+.,-])(?:0|\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?)\d(?:[ .-]\d{2}){4}(?![\w]|[ .,-]\d)|(?<![\w+.,-])[02-9]\d{9}(?!\w|[.,-]\d)")),
)
DIGIT = re.compile(r"\d[\d.\- ()]{5}")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
MAX_DRAWS = 64


class Draw:
    """An endless row of numbers for a keyed name."""

    def __init__(self, key: bytes, *name: str) -> None:
        self._key, self._name, self._no, self._block = key, "\0".join(name).encode(), 0, b""

    def __call__(self, below: int) -> int:
        if len(self._block) < 4:
            self._block = hmac.digest(self._key, self._no.to_bytes(4, "big") + self._name, hashlib.sha256)
            self._no += 1
        value, self._block = int.from_bytes(self._block[:4], "big"), self._block[4:]
        return value * below >> 32


def script_of(word: str) -> str:
    return next((name for name, letters in SCRIPTS if letters.search(word)), "latin")


def canonical(kind: str, text: str) -> str:
    """What makes two mentions the same entity: letter case and the punctuation of numbers do not."""
    if kind in ("card", "phone"):
        return "".join(c for c in text if c.isdigit())
    return text if kind == "secret" else text.lower()


def _mask(text: str, draw: Draw) -> str:
    """Each character replaced by one of its class: digits, hexadecimal runs, upper and lower case letters; others stay."""
    hexadecimal = "0123456789abcdef" if re.fullmatch(r"[0-9a-f]+", text) else "0123456789ABCDEF" if re.fullmatch(r"[0-9A-F]+", text) else ""
    out = []
    for c in text:
        if hexadecimal:
            out.append(hexadecimal[draw(16)])
        elif "0" <= c <= "9":
            out.append("0123456789"[draw(10)])
        elif "a" <= c <= "z":
            out.append(chr(97 + draw(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + draw(26)))
        else:
            out.append(c)
    return "".join(out)


def luhn(digits: str) -> bool:
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def surrogate(kind: str, entity: str, attempt: int, key: bytes) -> str:
    """Canonical surrogate of a canonical entity at its ``attempt``-th draw."""
    draw = Draw(key, kind, entity, str(attempt))
    longer = attempt // 16  # where a form is used up, surrogates grow
    if kind == "email":
        local, _, domain = entity.partition("@")
        labels = domain.split(".")
        return _mask(local + "x" * longer, draw) + "@" + ".".join([*(_mask(x, Draw(key, "domain", domain, x)) for x in labels[:-1]), labels[-1]])
    if kind == "ip":
        octets = entity.split(".")
        same = 2 if not longer and (octets[0] in ("10", "127") or entity.startswith(("192.168.", "169.254."))) else 0
        drawn = [str(1 + draw(254)) for _ in octets]
        if not same:
            drawn[0] = str(next(x for x in (11 + draw(212) for _ in range(99)) if x not in (127, 169, 172, 192)))
        return ".".join(octets[:same] + drawn[same:])
    if kind == "card":
        body = entity[0] + "".join(str(draw(10)) for _ in entity[2:])
        last = next(d for d in "0123456789" if luhn(body + d)) if luhn(entity) else str(draw(10))
        return body + last + "".join(str(draw(10)) for _ in range(longer))
    if kind == "phone":
        return "".join(str(draw(10)) if k > 1 else c if k == 0 else str(2 + draw(8)) for k, c in enumerate(entity + "0" * longer))
    if kind.startswith("given"):
        own = GIVEN[entity]
        names = NAMES[own].split()
        # a keyed order of the list, in which each name stands for the next: never itself, never two alike
        order = sorted(names, key=lambda n: hmac.digest(key, n.encode(), hashlib.sha256))
        return order[(order.index(entity) + 1) % len(order)]
    if kind == "surname":
        parts = SYLLABLES[script_of(entity)]
        return "".join(parts[draw(len(parts))] for _ in range(3 + (attempt + 1) // 2))
    return _mask(entity + "x" * longer, draw)


def shaped(kind: str, mention: str, new: str) -> str:
    """The canonical surrogate ``new`` in the format of ``mention``."""
    if kind in ("card", "phone"):
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in mention) + "".join(digits)
    if kind.startswith("given") or kind == "surname":
        return new.upper() if len(mention) > 1 and mention.isupper() else new.capitalize() if mention[:1].isupper() else new
    if kind == "email" and mention.isupper():
        return new.upper()
    return new


def mentions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order and not overlapping; earlier kinds of ``PATTERNS`` win."""
    found: list[tuple[int, int, str]] = []
    numbers, lower = DIGIT.search(text) is not None, text.lower()
    for kind, pattern in PATTERNS:
        if (kind == "email" and "@" not in text) or (kind in ("ip", "card", "phone") and not numbers):
            continue
        if kind == "secret" and "AKIA" not in text and not any(c in lower for c in CUES):
            continue
        for m in pattern.finditer(text):
            if kind == "card" and not 13 <= sum(c.isdigit() for c in m[0]) <= 19:
                continue
            start, end = m.span(m.lastindex or 0)
            if all(end <= a or start >= b for a, b, _ in found):
                found.append((start, end, kind))
    found += [m for m in _names(text) if all(m[1] <= a or m[0] >= b for a, b, _ in found)]
    return sorted(found)


def _names(text: str) -> list[tuple[int, int, str]]:
    """Given names in capitals with the surname that follows; surnames after a form of address, and those seen so, wherever they come again."""
    words = set(WORD.findall(text))
    known = {w for w in words if w[:1].isupper() and w.lower() in GIVEN}
    titled = {w for w in words if w.lower() in TITLES and w[:1].isupper()}
    if not known and not titled:
        return []
    out, surnames = [], set()
    spans = list(WORD.finditer(text))
    taken: set[int] = set()
    for k, m in enumerate(spans):
        if k in taken:
            continue
        following = spans[k + 1] if k + 1 < len(spans) else None
        near = following is not None and re.fullmatch(r"\.? {1,2}", text[m.end() : following.start()]) and following[0][:1].isupper()
        # a surname belongs to a name or title; the given name alone may start any sentence and is only taken with one
        if m[0] in known and near and text[m.end()] == " " and following[0] not in known:
            out += [(*m.span(), "given"), (*following.span(), "surname")]
            surnames.add(following[0].lower())
            taken.add(k + 1)
        elif m[0] in titled and near and following[0] not in known:
            out.append((*following.span(), "surname"))
            surnames.add(following[0].lower())
            taken.add(k + 1)
    starts = {a for a, _, _ in out}
    out += [(*m.span(), "surname") for m in spans if m.start() not in starts and m[0][:1].isupper() and m[0].lower() in surnames]
    return out


def _found(docs: DataFrame) -> DataFrame:
    """Distinct entities of each document: ``a``, ``b`` (its key), ``kind``, ``entity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, names = [], [], []
            for row, text in enumerate(batch.column(2).to_pylist()):
                for kind, entity in sorted({(k, canonical(k, text[s:e])) for s, e, k in mentions(text)}) if text else ():
                    at.append(row)
                    kinds.append(kind)
                    names.append(entity)
            keys = [batch.column(k).take(pa.array(at, pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(kinds, pa.string()), pa.array(names, pa.string())], ["a", "b", "kind", "entity"])

    return docs.mapInArrow(run, "a bigint, b bigint, kind string, entity string")


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, names, draws = (c.to_pylist() for c in batch.columns)
            new = [surrogate(k, e, n, key) for k, e, n in zip(kinds, names, draws)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], ["kind", "entity", "attempt", "new"])

    return entities.select("kind", "entity", "attempt").mapInArrow(run, "kind string, entity string, attempt int, new string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind``, ``entity``, ``attempt``, ``new`` of distinct (kind, entity): no two entities of a kind share a surrogate and none gets that of
    a real entity. Given names are exchanged within their list and need no check. Fails if a kind has no free surrogates after many draws."""
    table = checkpoint(_drawn(entities.withColumn("attempt", F.lit(0)), key))
    checked = F.col("kind") != "given"
    for _ in range(MAX_DRAWS):
        settled = table.where(checked).groupBy("kind", "new").agg(F.min(F.struct("attempt", "entity")).alias("first"), F.count(F.lit(1)).alias("n"))
        shared = table.where(checked).join(settled.where("n > 1").select("kind", "new", "first"), ["kind", "new"])
        clash = shared.where(F.struct("attempt", "entity") != F.col("first")).select("kind", "entity")
        real = table.where(checked).join(table.select("kind", F.col("entity").alias("new")), ["kind", "new"], "left_semi").select("kind", "entity")
        again, n = checkpoint_counting(clash.union(real).distinct(), F.lit(True))
        if not n:
            return table
        redrawn = _drawn(table.join(again, ["kind", "entity"], "left_semi").withColumn("attempt", F.col("attempt") + 1), key)
        table = checkpoint(table.join(again, ["kind", "entity"], "left_anti").unionByName(redrawn))
    raise ValueError("surrogates keep colliding: a kind of entity has too few forms")


def replace(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` as ``row``, with ``n_entities`` (mentions replaced) and the new ``text``.

    Null texts stay null and empty ones empty, with no mention. Rows equal in id and text get equal results; null ids are as good as others.
    An entity is replaced alike everywhere. An empty table gives an empty result; names cannot clash, all columns are inside ``row``.
    """
    secret = hashlib.sha256(key.encode()).digest()
    docs = df.select(packed(df).alias("row"), F.col(text_col).alias("text"), text_key(id_col, text_col).alias("key"))
    docs = docs.select("row", "text", F.col("key.a").alias("a"), F.col("key.b").alias("b"))
    found = checkpoint(_found(docs.select("a", "b", "text")))
    named = assign(found.select("kind", "entity").distinct(), secret)
    # what differs from the first draw has to be told to the documents concerned
    moved = checkpoint(named.where("attempt > 0").select("kind", "entity", "new"))
    told = found.join(moved, ["kind", "entity"]).groupBy("a", "b").agg(F.collect_set(F.struct("kind", "entity", "new")).alias("moved"))
    told = checkpoint(told)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple[str, str], str] = {}
        for batch in batches:
            counts, texts = [], []
            if len(memo) > 1 << 17:
                memo.clear()
            for text, moved in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {(m["kind"], m["entity"]): m["new"] for m in moved or ()}
                at, parts, spans = 0, [], mentions(text) if text else []
                for start, end, kind in spans:
                    mention = text[start:end]
                    name = kind, canonical(kind, mention)
                    new = own.get(name) or memo.get(name)
                    if new is None:
                        new = memo[name] = surrogate(*name, 0, secret)
                    parts += [text[at:start], shaped(kind, mention, new)]
                    at = end
                counts.append(len(spans))
                texts.append(None if text is None else "".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(counts, pa.int64()), pa.array(texts, pa.string())], ["row", "n_entities", "text"])

    joined = docs.join(told, ["a", "b"], "left").select("text", "moved", "row")
    row = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(run, f"row {row}, n_entities bigint, text string")
