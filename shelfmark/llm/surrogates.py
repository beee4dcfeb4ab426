"""Personal data replaced by surrogates.

Detected entities get keyed replacements of their own type: the same entity gets the same surrogate
in all documents (coreference) and in each of the ways it is written, different entities get
different ones (distinctness).  A surrogate follows the gender, script, length and format of what it
stands for.  Before anything is replaced, the surrogates of all distinct entities of the corpus are
compared: those that meet another entity's surrogate, or an entity that really occurs, are drawn
again until none does.  Where a format has no free surrogate left, as short numbers may, the entity
gets a keyed token instead.  Then every text is rewritten in its own row.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import broadcast_if_small, variant
from shelfmark.shared import written

KEY = b"shelfmark surrogates"  # parameter: whoever knows it can test guesses, so set your own
MOST_DRAWS = 16  # draws in the entity's own format; from then on it gets a token

KINDS = ("email", "secret", "ip", "card", "phone", "given", "family")

# Titles and the gender they tell, given names by gender and script.
TITLES = {
    "mr": "male", "herr": "male", "señor": "male", "sr": "male", "monsieur": "male", "господин": "male",
    "mrs": "female", "ms": "female", "miss": "female", "frau": "female", "señora": "female",
    "sra": "female", "madame": "female", "mme": "female", "госпожа": "female",
    "dr": "", "prof": "", "доктор": "",
}
GIVEN = {
    ("LATIN", "male"): "Adam Bruno Carl Daniel Emil Felix Henry Ivan Jonas Karl Leo Martin Oscar Paul Simon Victor".split(),
    ("LATIN", "female"): "Alice Berta Clara Diana Emma Flora Helena Irene Julia Karla Laura Maria Nora Olga Rosa Vera".split(),
    ("CYRILLIC", "male"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("CYRILLIC", "female"): "Анна Вера Дарья Елена Зоя Ирина Ксения Лидия Мария Нина".split(),
}
SYLLABLES = {
    "LATIN": "bal ben cor dan del fer gar hol kel lan mar mor nel per ros sal tan ver wil zan".split(),
    "CYRILLIC": "бар вол гор дан зор кал лев мар нов пет рад сол тар вел кру лан мир сав тол фед".split(),
}

ALPHABETS = {"LATIN": "abcdefghijklmnopqrstuvwxyz", "CYRILLIC": "абвгдежзийклмнопрстуфхцчшщъыьэюя"}

_TITLED = "|".join(sorted((re.escape(t) for t in TITLES), key=len, reverse=True))
_FIND = re.compile(
    r"(?P<email>(?<![\w.%+\-])[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)+)"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))"
    r"|(?P<card>(?<![\w+])\d{4}([ \-]?)\d{4}\5\d{4}\5\d{1,7}(?!\w))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?!\w)"
    r"|(?<![\w.])\+\d{8,15}(?!\w))"
)
# What every entity has: an at sign or a digit, or a title.  Most texts have none of them; titles
# are first looked for as plain strings, which is faster than as a pattern.
_HINT = re.compile(r"[@\d]")
_TITLE = re.compile(rf"(?<!\w)(?:(?i:{_TITLED})\.? )+")
_PLAIN = [t + end for t in TITLES for end in (" ", ". ")]
_INITIAL = re.compile(r"[^\W\d_]\.")
_PART = re.compile(r"(?<!\w)[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_INSIDE = re.compile(r"[^\W\d_]+")
# What may stand before and between parts of a name in small letters.
PARTICLES = set("de la las los del della der den di da do dos das du des van von vom zu zum zur ten ter le el al af av bin ibn ben y".split())
# Words that are no later mention of a person, though all-capital lines may have them as parts of a name.
COMMON = set(
    "the a an and or of in on at to for from by with is was are were be has had have he she it they we you his her their our "
    "my this that these those as but not no if so who when where what how why which will would can could may might do does "
    "did said says after before then there here all any some one two".split()
)


class Found(NamedTuple):
    """An entity in a text: its place, its kind, what it is however it is written."""

    start: int
    end: int
    kind: str
    value: str


def _script(word: str) -> str:
    name = unicodedata.name(word[0], "LATIN").split(" ")[0]
    return name if name in SYLLABLES else "LATIN"


def _listed(given: str) -> str:
    return next((g for (_, g), names in GIVEN.items() if given.title() in names), "")


def _parts(text: str, at: int) -> list[tuple[int, int, bool]]:
    """Start, end and whether it is an initial of all parts of the name at a place."""
    parts = []
    while at < len(text):
        if text[at].isupper() and _INITIAL.match(text, at):
            parts.append((at, at + 1, True))
            at += 3 if text[at + 2 : at + 3] == " " else 2
            continue
        m = _PART.match(text, at) or (_INSIDE.match(text, at) if parts else None)
        title = _TITLE.match(text, at) if parts else None
        if not m or (title and text[title.end() : title.end() + 1].isupper()):
            break
        word, end = m[0], m.end()
        # Small first letters: particles, and names such as d'Angelo.
        glued = re.split(r"['’\-]", word)
        named = word[0].isupper() or (len(glued) > 1 and len(glued[0]) < 4 and glued[1][0].isupper())
        if not named and word.lower() not in PARTICLES:
            break
        own = len(glued) > 1 and word[-2:].lower() in ("'s", "’s")
        if named:
            parts.append((at, end - 2 * own, False))
        if own or text[end : end + 1] != " ":
            break
        at = end + 1
    last = max((k for k, p in enumerate(parts) if not p[2]), default=0)
    return [(a, b, i or (b - a == 1 and k < last)) for k, (a, b, i) in enumerate(parts)]


def _name(said: str) -> str:
    return said.lower().replace("’", "'")


def _persons(text: str, taken: list[Found]) -> list[Found]:
    """Names behind titles, and all other mentions of these names in the text."""
    ends = {f.start: f.end for f in taken}
    starts = sorted(ends)

    def free(start: int, end: int) -> bool:
        k = bisect(starts, start)
        return not (k and ends[starts[k - 1]] > start or k < len(starts) and starts[k] < end)

    def take(start: int, end: int, kind: str, value: str) -> None:
        found.append(Found(start, end, kind, value))
        ends[start] = end
        starts.insert(bisect(starts, start), start)

    found, persons, told, families = [], [], {}, set()
    for m in _TITLE.finditer(text):
        gender = next(filter(None, (TITLES[t.rstrip(".")] for t in m[0].lower().split())), "")
        parts = [p for p in _parts(text, m.end()) if free(p[0], p[1])]
        names = [_name(text[a:b]) for a, b, initial in parts if not initial]
        persons.append((gender, parts, len(names)))
        if len(names) > 1:
            families.add(names[-1])
            for name in names[:-1]:
                told[name] = told.get(name) or gender
    known = {}
    for gender, parts, n in persons:
        k = 0
        for start, end, initial in parts:
            if not free(start, end):
                continue
            name = _name(text[start:end])
            if initial:
                take(start, end, "given", f":{name}.")
                continue
            k += 1
            given = k < n or (n == 1 and name in told and name not in families)
            kind = "given" if given else "family"
            value = f"{gender or told.get(name) or _listed(name)}:{name}" if given else name
            take(start, end, kind, value)
            if len(name) > 1 and name not in COMMON:
                known.setdefault(name, (kind, value))
    for m in _PART.finditer(text) if known else ():
        said = m[0] if m[0][-2:].lower() not in ("'s", "’s") else m[0][:-2]
        whole = [(m.start(), m.start() + len(said))]
        if _name(said) not in known:
            whole = [(m.start() + p.start(), m.start() + p.end()) for p in _INSIDE.finditer(m[0])]
        for start, end in whole:
            entity = known.get(_name(text[start:end]))
            if entity and any(c.isupper() for c in text[start:end]) and free(start, end):
                take(start, end, *entity)
    return found


def find(text: str) -> list[Found]:
    """All entities of a text, in order.

    Of a titled person, given and family names are entities of their own, so that "Mr Smith" stays
    the same family as "Mr John Smith".  All parts written with capitals are taken, and all other
    mentions of them in the text, with or without title.  A given name has the gender of its title,
    else the one told of it in the text, else the one of the lists; else none (see ``_told``).
    """
    if not _HINT.search(text):
        lowered = text.lower()
        if not any(t in lowered for t in _PLAIN) or not _TITLE.search(text):
            return []
    found = []
    for m in _FIND.finditer(text):
        kind, said = m.lastgroup, m[0]
        if kind in ("phone", "card"):
            digits = re.sub(r"\D", "", said)
            if kind == "phone" and len(digits) == 11 and digits[0] == "1":
                digits = digits[1:]
            found.append(Found(*m.span(), kind, digits))
        else:
            found.append(Found(*m.span(), kind, said.lower()))
    return sorted(found + _persons(text, found))


def _number(key: bytes, *parts: object) -> int:
    text = "|".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(text, key=key, digest_size=64).digest())


def _luhn(digits: str) -> int:
    twice = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(n - 9 if n > 9 else n for n in twice) % 10


def _like(value: str, n: int) -> str:
    """Letters for letters, digits for digits, the rest as it is; letters stay in their script."""
    out = []
    for c in value:
        n, r = divmod(n, 26 * 10 * 32)
        if c.isdigit():
            out.append(str(r % 10))
        elif c.isalpha() and not c.isascii() and _script(c) == "CYRILLIC":
            out.append(chr(ord("а") + r % 32))
        elif c.isalpha():
            out.append(chr(ord("a") + r % 26))
        else:
            out.append(c)
        if not n:
            n = r + 1 << 40
    return "".join(out)


def surrogate(kind: str, value: str, draw: int, key: bytes) -> str:
    """The ``draw``-th surrogate of an entity: a function of the key, its kind and its value alone.

    After ``MOST_DRAWS`` draws it is a token of 128 bits that is nothing ``find`` looks for.
    """
    n = _number(key, kind, value, draw)
    if draw >= MOST_DRAWS:
        return kind + "".join(SYLLABLES["LATIN"][n >> 8 * k & 15] for k in range(32))
    if kind == "email":
        local, _, domain = value.partition("@")
        # The domain is drawn by itself, so people of one domain stay together; it is a reserved one.
        name = _like("aaaaaa00", _number(key, "domain", domain))
        return f"{_like(local, n)}{'' if draw < 4 else draw}@{name}.example.com"
    if kind == "secret":
        return "".join("0123456789abcdef"[b & 15] for b in (n.to_bytes(64) * (len(value) // 64 + 1))[: len(value)])
    if kind == "ip":
        # Reserved addresses reach nobody; if they run short, any will do.
        first = 240 + n % 16 if draw < 8 else n % 256
        return ".".join(map(str, (first, n >> 8 & 255, n >> 16 & 255, n >> 24 & 255)))
    if kind in ("card", "phone"):
        digits = str(1 + n % 9) + str(n // 9).zfill(len(value))[-(len(value) - 1) :]
        if kind == "card":
            # As valid, or not, as what it stands for.
            shift = (_luhn(value) - _luhn(digits)) % 10
            digits = digits[:-1] + str((int(digits[-1]) + shift) % 10)
        return digits
    if kind == "given":
        gender, _, name = value.partition(":")
        script = _script(name)
        if name.endswith("."):
            # An initial: the next one in a keyed order, so that different ones stay apart.
            letters = sorted(ALPHABETS[script], key=lambda c: _number(key, "initial", c))
            at = letters.index(name[0]) + 1 if name[0] in letters else n
            return letters[at % len(letters)]
        names = [x for (s, g), all_ in GIVEN.items() if s == script and gender in ("", g) for x in all_]
        picked, n = names[n % len(names)], n // len(names)
        # A list of names is short: more draws lengthen them.
        return picked.lower() + "".join(SYLLABLES[script][n >> 8 * k & 15] for k in range(min(draw, 6)))
    syllables = SYLLABLES[_script(value)]
    return "".join(syllables[n >> 8 * k & 15] for k in range(3 + draw // 2))


def _pour(kind: str, said: str, drawn: str) -> str:
    """A surrogate written the way the entity was; a token as it is."""
    if kind in ("phone", "card") and drawn.isdigit():
        places = sum(c.isdigit() for c in said)
        rest = iter("1" * (places - len(drawn)) + drawn)
        return "".join(next(rest) if c.isdigit() else c for c in said)
    letters = [c for c in said if c.isalpha()]
    if letters and all(c.isupper() for c in letters):
        return drawn.upper()
    return drawn.capitalize() if kind in ("given", "family") else drawn


def replaced(text: str, draws: dict[tuple[str, str], tuple[str, int]], key: bytes) -> tuple[str, list[Found]]:
    """The text with surrogates, and what was found; ``draws`` has value and draw of the entities that
    were drawn again or had their gender told elsewhere."""
    found, out, at = find(text), [], 0
    for f in found:
        drawn = surrogate(f.kind, *draws.get((f.kind, f.value), (f.value, 0)), key)
        out += [text[at : f.start], _pour(f.kind, text[f.start : f.end], drawn)]
        at = f.end
    return "".join([*out, text[at:]]), found


def _occurrences(rows: DataFrame) -> DataFrame:
    """``doc_id, variant, kind, value``, distinct within each text; initials are left out."""

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, values = [], [], []
            for i, text in enumerate(batch.column(2)):
                for kind, value in sorted({(f.kind, f.value) for f in find(text.as_py() or "") if f.kind != "given" or f.value[-1] != "."}):
                    at.append(i)
                    kinds.append(kind)
                    values.append(value)
            ids = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            columns = [*ids.columns, pa.array(kinds, pa.string()), pa.array(values, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "variant", "kind", "value"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "variant", "text").mapInArrow(
        seek, f"doc_id {kind}, variant long, kind string, value string"
    )


def _told(occurrences: DataFrame) -> DataFrame:
    """``occurrences`` with ``said``: given names without gender get as ``value`` the one with the
    gender most texts tell of the name, so that a person is the same with any title."""
    given = occurrences.where("kind = 'given'").select(
        F.substring_index("value", ":", 1).alias("gender"), F.substring_index("value", ":", -1).alias("name")
    )
    counted = given.where("gender <> ''").groupBy("name", "gender").agg(F.count("*").alias("n"))
    most = counted.groupBy("name").agg(F.max(F.struct("n", "gender"))["gender"].alias("gender"))
    named = most.join(given.where("gender = ''").select("name").distinct(), "name").select(
        F.lit("given").alias("kind"),
        F.concat(F.lit(":"), "name").alias("value"),
        F.concat("gender", F.lit(":"), "name").alias("as"),
    )
    return occurrences.join(named, ["kind", "value"], "left").select(
        "doc_id", "variant", "kind", F.col("value").alias("said"), F.coalesce("as", "value").alias("value")
    )


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    """``kind, value, draw, drawn``: the surrogates of ``kind, value, draw``."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)
            found = pa.array([surrogate(k, v, n, key) for k, v, n in asked], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=["kind", "value", "draw", "drawn"])

    return entities.select("kind", "value", "draw").mapInArrow(
        draw, "kind string, value string, draw int, drawn string"
    )


def redrawn(occurrences: DataFrame, key: bytes = KEY) -> DataFrame:
    """``kind, value, draw`` of the entities whose first surrogate could not stay.

    In every round, of the entities with one surrogate the one of fewest draws, then the least,
    keeps it; the others, and those whose surrogate is an entity of the corpus, draw again.  A drawn
    name is compared with all real names, given ones without their gender and family names.

    A surrogate that was kept stays, so a round handles only those who lost the round before, and
    writes them and their new surrogates.  The rounds end, since tokens of 128 bits follow.
    """
    real = written(occurrences.select("kind", "value").distinct(), "entities")
    like = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind"))
    bare = F.when(F.col("kind") == "given", F.substring_index("value", ":", -1)).otherwise(F.col("value"))
    taken = real.select(like.alias("like"), bare.alias("drawn")).distinct()
    asked, kept, draw = real, None, 0
    while True:
        own = written(_drawn(asked.withColumn("draw", F.lit(draw)), key), "drawn")
        # The surrogates that this round asked for are few after the first one, so they are looked up.
        wanted = own.select("kind", "drawn").distinct()
        given_away = taken.join(wanted.withColumn("like", like), ["like", "drawn"]).select("kind", "drawn")
        if kept is not None:
            given_away = given_away.union(kept.join(wanted, ["kind", "drawn"], "left_semi").select("kind", "drawn"))
        free = own.join(given_away.distinct(), ["kind", "drawn"], "left_anti")
        winners = written(
            free.groupBy("kind", "drawn").agg(F.min("value").alias("value"), F.lit(draw).alias("draw")), "kept"
        )
        kept = winners if kept is None else kept.union(winners)
        asked = written(own.join(winners, ["kind", "value"], "left_anti").select("kind", "value"), "losers")
        if asked.isEmpty():
            return kept.where("draw > 0").select("kind", "value", "draw")
        draw += 1


def with_surrogates(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``doc_id, text, n_entities`` and ``n_<kind>`` for every row of ``docs``, whole texts rewritten.

    A null text stays null with nothing found; an empty one stays empty.  Rows of equal id are told
    apart by their text.  Other columns are not read; an empty table gives no rows.  The entities
    themselves are kept in the shared folder while the application runs.
    """
    rows = docs.select("doc_id", "text").withColumn("variant", variant(docs))
    occurrences = written(_told(written(_occurrences(rows), "occurrences")), "told")
    draws = (
        occurrences.join(redrawn(occurrences, key), ["kind", "value"], "left")
        .where("draw IS NOT NULL OR said <> value")
        .groupBy("doc_id", "variant")
        .agg(F.collect_set(F.struct("kind", "said", "value", F.coalesce("draw", F.lit(0)).alias("draw"))).alias("draws"))
    )
    draws = broadcast_if_small(written(draws.toDF("_doc_id", "_variant", "draws"), "draws"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("variant").eqNullSafe(F.col("_variant"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text", "n_entities", *(f"n_{k}" for k in KINDS)]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], [[] for _ in names[2:]]
            for text, again in zip(batch.column(1), batch.column(2), strict=True):
                own = {(d["kind"], d["said"]): (d["value"], d["draw"]) for d in again.as_py() or ()}
                new, found = replaced(text.as_py() or "", own, key)
                texts.append(new if text.is_valid else None)
                numbers = [len(found), *(sum(f.kind == k for f in found) for k in KINDS)]
                for column, number in zip(counts, numbers, strict=True):
                    column.append(number)
            columns = [batch.column(0), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in counts)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    numbers = ", ".join(f"{n} long" for n in names[2:])
    return (
        rows.join(draws, same, "left")
        .select("doc_id", "text", "draws")
        .mapInArrow(rewrite, f"doc_id {kind}, text string, {numbers}")
    )
