"""Personal data: keyed, type-consistent surrogates.

Detected entities (e-mail, phone, card, IBAN, social security number, IPv4, IPv6,
person names) are replaced by surrogates derived from a secret key.  A name is
found after one or more titles or greetings ("Dear Mr. Smith"), as a known
given name with a capitalised word after it, and, once a document has it,
wherever its words stand in that document again.  A possessive 's is not part of it.
A surrogate keeps type and format: lengths, punctuation,
letter case, country code, valid check digits, script (Latin, Cyrillic, Greek,
Han) and, for names, gender.  The same entity gets the same surrogate everywhere,
however it is written; a name's words are entities of their own, so "Mr. John
Smith", "Dr. Smith" and "Dear Smith" stay related.  What a word is (surname,
male, female or other given name) is settled once, by most of its sightings;
those that tell nothing, after a neutral title or a greeting, count only where
there are no others.

Surrogates are assigned once per distinct entity, on a table.  Collision checks
follow in rounds: of entities of one kind (all names are one) with the same
surrogate the smallest keeps it, the rest, and all whose surrogate is a real entity, try the next
one, until no collision is left.  After ``WIDEN_AFTER`` tries a surrogate may
grow by a character, so small spaces end too.

Phone numbers are found with a leading +, in the North American 3-3-4 form and
grouped with a leading 0 or 00 ("030 12345678", "06 12 34 56 78", "0049 30
1234567"; "0049" and "+49" are the same entity).  Numbers without any of these,
such as "912 345 678" or "03012345678", cannot be told from other numbers and
stay.

Only rows with entities are shuffled; rows without pass through.

Defined cases: a null text stays null, an empty one empty; very long texts are
searched whole; repeated rows are
treated alike; overlapping finds go to the leftmost, then to the kind listed
first; other columns pass through inside one struct, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oriel.llm.common import materialize, read_table

KINDS = ["email", "iban", "card", "ssn", "ipv4", "ipv6", "phone", "name"]
WIDEN_AFTER = 12

EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
DIGITS = re.compile(r"(?<![\w.+-])\(?\+?\(?\d(?:[ ().-]{0,2}\d){6,18}(?![\w-]|\.\d)")
IPV4 = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
NANP = re.compile(r"\(?\+?1?[ .-]?\(?[2-9]\d\d\)?[ .-]\d{3}[ .-]\d{4}(?![\w-]|\.\d)")
# after 00 and country code; five pairs; area code of two digits (not a date); longer area code
NATIONAL = re.compile(r"(?<![\w.,:+/-])\(?(?:00 ?[1-9]\d{0,2}(?:[ .-]?\(\d{1,5}\)[ .-]?\d+|[ ./-]\d+)(?:[ ./-]\d+){0,6}"
                      r"|0[1-9](?:[ .-]\d\d){4}|0[1-9]\)?(?:[ /-]\d{6,8}|[ -]\d{3,4}[ -]\d{3,4})"
                      r"|0[1-9]\d{1,4}\)?(?: ?[/-] ?|[ .])\d{2,8}(?:[ .-]\d{2,6}){0,3})(?![\w/-]|[.,:]\d)")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f:]{2,39}(?![\w:])")
SSN = re.compile(r"\d{3}-\d{2}-\d{4}")
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Sir", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Signora", "Madam", "Госпожа", "Κυρία"]
NEUTRAL = ["Dr", "Prof", "Professor", "Dear", "Mx"]
TITLES = {t: g for names, g in ((MALE, "m"), (FEMALE, "f"), (NEUTRAL, None)) for n in names for t in (n, n.upper())}
_UPPER = "A-ZÀ-ÖØ-ÞА-ЯΑ-Ω"
_HAN = "\u4e00-\u9fff"
_WORD = rf"(?:[{_UPPER}](?:\w|['’](?!s\b|S\b)|-(?=\w)){{1,30}}|[{_HAN}]{{1,4}})"
CAPITAL = re.compile(rf"(?<!\w)[{_UPPER}]\w+")
TITLE = re.compile(r"(\w+)\.?[ \t]+")
NAME = re.compile(rf"{_WORD}(?:[ \t]+{_WORD}){{0,2}}")

# Capitalised words that may follow a name and are no part of it.
NO_NAME = ("yesterday today tomorrow now then later soon monday tuesday wednesday thursday friday saturday sunday january february march april "
           "june july august september october november december i we you he she it they the a an and or but if when please thank thanks hello "
           "gestern heute morgen hier aujourd ayer hoy").split()
# Words after a greeting that name nobody.
GENERIC = "sir madam all team customer customers colleague colleagues friend friends reader readers guest guests".split()
# Given names from which gender is read where no title tells it.
GIVEN_MALE = "james john robert michael william david richard joseph thomas charles peter paul hans karl jean pierre jose juan carlos luis иван дмитрий сергей".split()
GIVEN_FEMALE = "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna maria marie sophie julia laura carmen ana elena анна мария ольга".split()

GIVEN = {w: g for words, g in ((GIVEN_MALE, "m"), (GIVEN_FEMALE, "f")) for w in words}

# Surrogate names are built from syllables; the ending tells the gender.
SYLLABLES = {
    "latin": (["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "br", "dr", "kl", "st", "tr"], ["a", "e", "i", "o", "u"],
              {"m": ["n", "r", "s", "k"], "f": ["a", "ia", "ina"], "s": ["son", "man", "ner", "well"], "n": ["el", "y", "en"]}),
    "cyrillic": (["б", "в", "г", "д", "к", "л", "м", "н", "п", "р", "с", "т"], ["а", "е", "и", "о", "у"],
                 {"m": ["н", "р", "м", "с"], "f": ["а", "ия", "ина"], "s": ["ов", "ев", "ин", "ский"], "n": ["ль", "й"]}),
    "greek": (["β", "γ", "δ", "κ", "λ", "μ", "ν", "π", "ρ", "σ", "τ"], ["α", "ε", "ι", "ο", "υ"],
              {"m": ["ος", "ης", "ας"], "f": ["α", "η", "ια"], "s": ["ιδης", "ακης", "ου"], "n": ["ι", "ω"]}),
    "han": (list("山川林森石松竹梅金北南東西高中大小上"), list("田村本原井野沢島崎口"),
            {"m": ["郎", "夫", "男"], "f": ["子", "美", "恵"], "s": ["", "木", "川"], "n": ["真", "光"]}),
}


def script_of(word: str) -> str:
    for c in word:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
        if "\u4e00" <= c <= "\u9fff":
            return "han"
    return "latin"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _is_ipv6(s: str) -> bool:
    try:
        return ipaddress.IPv6Address(s).packed != b"\0" * 16
    except ValueError:
        return False


def _number_kind(s: str) -> str | None:
    digits = re.sub(r"\D", "", s)
    if SSN.fullmatch(s):
        return "ssn"
    if 13 <= len(digits) <= 19 and "+" not in s and (luhn(digits) or len(digits) == len(s) == 16 and s[0] in "3456"):
        return "card"
    return "phone" if 8 <= len(digits) <= 15 and s.lstrip("(").startswith("+") else None


def names(text: str) -> list[tuple[int, int, str, str]]:
    """Names word by word: after titles, or a known given name and a word; then
    all other places of the words found."""
    hits, at, known = [], 0, {}
    for m in CAPITAL.finditer(text):
        if m.start() < at:
            continue
        start, gender, titled = m.start(), None, False
        while (t := TITLE.match(text, start)) and t.group(1) in TITLES:
            following = NAME.match(text, t.end())
            if not following or (following.group().split()[0].casefold() in GENERIC):
                break
            start, gender, titled = t.end(), TITLES[t.group(1)] or gender, True
        if not titled and m.group().casefold() not in GIVEN:
            continue
        if not (name := NAME.match(text, start)):
            continue
        words = list(re.finditer(r"\S+", name.group()))
        for i in range(1, len(words)):          # a later word that is none, and all after it
            if words[i].group().casefold() in NO_NAME or words[i].group() in TITLES:
                words = words[:i]
                break
        if words[0].group().casefold() in GENERIC or words[0].group() in TITLES or not titled and len(words) < 2:
            continue
        for i, w in enumerate(words):
            word = w.group().casefold()
            last = i == len(words) - 1 and (len(words) > 1 or gender)
            kind = "s" if last else gender or GIVEN.get(word, "n")
            hits.append((start + w.start(), start + w.end(), f"name:{kind}", word))
            known.setdefault(w.group(), f"name:{kind}")
        at = start + words[-1].end()
    if known:
        taken = {h[0] for h in hits}
        again = re.compile(rf"(?<![\w])(?:{'|'.join(map(re.escape, sorted(known, key=len, reverse=True)))})(?![\w])")
        hits += [(m.start(), m.end(), known[m.group()], m.group().casefold()) for m in again.finditer(text) if m.start() not in taken]
    return hits


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form), not overlapping, by position.  Names
    come word by word with the kinds name:m, name:f, name:n (given) and name:s."""
    if not text:
        return []
    hits = []
    if "@" in text:
        hits += [(m.start(), m.end(), "email", m.group().lower()) for m in EMAIL.finditer(text)]
    for m in IBAN.finditer(text):
        code = m.group().replace(" ", "")
        if 15 <= len(code) <= 34 and iban_rest(code) == 1:
            hits.append((m.start(), m.end(), "iban", code))
    for m in IPV4.finditer(text):
        hits.append((m.start(), m.end(), "ipv4", m.group()))
    if "::" in text or text.count(":") > 6:
        for m in IPV6.finditer(text):
            # short ones without a digit are more likely code or prose
            if ("::" in m.group() or m.group().count(":") == 7) and len(m.group()) > 6 and re.search(r"\d", m.group()) and _is_ipv6(m.group()):
                hits.append((m.start(), m.end(), "ipv6", m.group().lower()))
    national = {}
    for m in NATIONAL.finditer(text):
        code = re.sub(r"\D", "", m.group())
        code = "+" + code[2:] if code.startswith("00") else code
        if 8 <= len(code.lstrip("+")) <= 15 and not SSN.fullmatch(m.group()):
            national[m.start()] = m.end()
            hits.append((m.start(), m.end(), "phone", code))
    at = 0
    while m := DIGITS.search(text, at):
        if m.start() in national:
            at = national[m.start()]
            continue
        if us := NANP.match(text, m.start()):
            hits.append((us.start(), us.end(), "phone", ("+" if "+" in us.group() else "") + re.sub(r"\D", "", us.group())))
            at = us.end()
            continue
        # a number may have run into the next one: cut at spaces until it is of a kind
        s = m.group()
        while not (kind := _number_kind(s)) and " " in s:
            s = s[:s.rfind(" ")].rstrip(" ().-")
        if kind:
            hits.append((m.start(), m.start() + len(s), kind, ("+" if "+" in s else "") + re.sub(r"\D", "", s)))
        at = m.start() + max(1, len(s))
    hits += names(text)
    out, end = [], 0
    for h in sorted(hits, key=lambda h: (h[0], KINDS.index(h[2].split(":")[0]))):
        if h[0] >= end:
            out.append(h)
            end = h[1]
    return out


def _stream(key: bytes, kind: str, value: str, attempt: int):
    n = 0
    while True:
        yield from hmac.new(key, f"{kind}\0{value}\0{attempt}\0{n}".encode(), hashlib.sha256).digest()
        n += 1


def _like(value: str, draw) -> str:
    """Letters for letters (of the same case), digits for digits, the rest kept."""
    out = []
    for c in value:
        if c.isdigit():
            out.append("0123456789"[next(draw) % 10])
        elif c.isascii() and c.isalpha():
            x = "abcdefghijklmnopqrstuvwxyz"[next(draw) % 26]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """Surrogate of a canonical value."""
    draw = _stream(key, kind.split(":")[0], value, attempt)  # a name's word has one stem, whatever it is taken for
    wide = max(0, attempt - WIDEN_AFTER)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        # domains are entities too: the same one always gets the same surrogate
        other = [_like(x, _stream(key, "domain", ".".join(labels[i:]), 0)) for i, x in enumerate(labels[:-1])]
        return f"{_like(local + 'x' * wide, draw)}@{'.'.join([*other, labels[-1]])}"
    if kind == "card":
        body = value[0] + _like(value[1:-1] + "0" * wide, draw)
        if luhn(value):
            return next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return body + str(next(draw) % 10)
    if kind == "iban":
        body = _like(value[4:] + "0" * wide, draw)
        return f"{value[:2]}{98 - iban_rest(value[:2] + '00' + body):02d}{body}"
    if kind == "ipv4":
        return ".".join(str(1 + next(draw) % 254) for _ in range(4))   # 4e9 of them: another try always helps
    if kind == "ipv6":
        digits = (f"{next(draw) % 15 + 1:x}" for _ in iter(int, 1))
        return "".join(next(digits) if c != ":" else c for c in value) + "".join(next(digits) for _ in range(wide))
    if kind == "phone":
        head = re.match(r"\+1|\+\d\d|\+?", value).group()
        rest = _like(value[len(head):] + "0" * wide, draw)
        if not head and len(rest) > 1 and value[0] == "0" != value[1]:
            return f"0{1 + int(rest[1]) % 9}{rest[2:]}"
        return head + (str(2 + int(rest[0]) % 8) + rest[1:] if rest and value[len(head)] != "0" else "0" + rest[1:])
    if kind.startswith("name:"):
        onset, vowel, ends = SYLLABLES[script_of(value)]
        pick = lambda xs: xs[next(draw) % len(xs)]
        return "".join(pick(onset) + pick(vowel) for _ in range((1 if script_of(value) == "han" else 2) + wide)) + pick(ends[kind[-1]])
    return _like(value + "0" * wide, draw)


def render(kind: str, surface: str, new: str) -> str:
    """A surrogate written as the entity was written."""
    if kind == "ipv4":
        return new
    if kind.startswith("name:"):
        return new.upper() if surface.isupper() else new[0].upper() + new[1:]
    if kind in ("email", "ipv6"):
        return "".join(n.upper() if s.isupper() else n for s, n in zip(surface, new, strict=False)) + new[len(surface):]
    # an international number may be written with 00 for +
    chars, out = iter("00" + new[1:] if new[0] == "+" and "+" not in surface else new.lstrip("+")), []
    for c in surface:
        out.append(next(chars) if c.isalnum() else c)
    return "".join(out) + "".join(chars)


ENTITY = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                   T.StructField("kind", T.StringType()), T.StructField("value", T.StringType())]))


def _finder(batches):
    names = ("start", "end", "kind", "value")
    for b in batches:
        got = [[dict(zip(names, e, strict=True)) for e in find(t.as_py())] for t in b.column(1)]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, kind)], names=["row", "text", "found"])


def detect(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, text, found): the other columns as a struct, the text, its entities."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0).alias("none")]
    src = docs.select(F.struct(*rest).alias("row"), F.col(f"`{text_col}`").alias("text"))
    return src.mapInArrow(_finder, T.StructType([*src.schema.fields, T.StructField("found", ENTITY)]))


def space() -> Column:
    """Kind within which an entity is one: that of all names is "name"."""
    return F.split("kind", ":")[0]


def settle(sightings: DataFrame) -> DataFrame:
    """Distinct (kind, value) of rows (kind, value): one kind per name's word,
    the most frequent one; name:n only where no sighting tells more."""
    counted = sightings.groupBy("kind", "value").agg(F.count("*").alias("n"))
    vote = F.struct(F.col("kind") != "name:n", F.col("n"), F.col("kind"))
    return counted.groupBy(space().alias("space"), "value").agg(F.max_by("kind", vote).alias("kind")).select("kind", "value")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, new) for distinct (kind, value): unique surrogates, none
    of them a real value of its kind; a name's word has one kind (``settle``)."""
    make = F.pandas_udf(lambda k, v, a: _series(key, k, v, a), "string")
    todo = entities.select("kind", "value", space().alias("space")).withColumn("attempt", F.lit(0))
    done = None
    while True:
        tried = materialize(todo.withColumn("new", make("kind", "value", "attempt")), "surrogates")
        taken = entities.select(space().alias("space"), F.col("value").alias("new"))
        if done is not None:
            taken = taken.unionByName(done.select(space().alias("space"), "new")).distinct()
        best = tried.groupBy("space", "new").agg(F.min("value").alias("best"))
        judged = (tried.join(best, ["space", "new"]).join(taken.withColumn("taken", F.lit(True)), ["space", "new"], "left")
                  .withColumn("ok", (F.col("value") == F.col("best")) & F.col("taken").isNull()))
        judged = materialize(judged.select("kind", "value", "space", "attempt", "new", "ok"), "judged")
        good = judged.where("ok").select("kind", "value", "new")
        done = good if done is None else done.unionByName(good)
        todo = judged.where("NOT ok").select("kind", "value", "space", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return done


def _series(key, kinds, values, attempts):
    import pandas as pd

    return pd.Series([surrogate(key, k, v, a) for k, v, a in zip(kinds, values, attempts, strict=True)], dtype=object)


def _writer(batches):
    for b in batches:
        texts = []
        for text, found, news in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            new_of = {n["i"]: n["new"] for n in news}
            out, at = [], 0
            for i, e in enumerate(found):
                out += [text[at:e["start"]], render(e["kind"], text[e["start"]:e["end"]], new_of[i])]
                at = e["end"]
            texts.append("".join([*out, text[at:]]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2)], names=["row", "text", "found"])


def pseudonymize(docs: DataFrame, key: bytes, text_col: str = "text", out: str = "n_entities") -> DataFrame:
    """``docs`` with entities replaced, plus ``out``: how many there were."""
    found = detect(docs, text_col)
    dirty = materialize(found.where(F.size("found") > 0).withColumn("rid", F.monotonically_increasing_id()), "pii-rows")
    each = dirty.select("rid", F.posexplode("found").alias("i", "e")).select("rid", "i", "e.kind", "e.value")
    new = assign(materialize(settle(each), "entities"), key).select(space().alias("space"), "value", "new")
    # an entity of very many rows: the table of surrogates has one row of it, so its join is split by adaptive execution
    named = each.withColumn("space", space()).join(new, ["space", "value"]).groupBy("rid").agg(F.collect_list(F.struct("i", "new")).alias("news"))
    schema = T.StructType([dirty.schema["row"], dirty.schema["text"], dirty.schema["found"]])
    changed = dirty.join(named, "rid").select("row", "text", "found", "news").mapInArrow(_writer, schema)
    both = changed.unionByName(found.where(F.size("found") == 0).select("row", "text", "found"))
    return both.select(*[(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c != out],
                       F.size("found").cast("long").alias(out))


def op3_pii(spark: SparkSession, sf_dir: str, key: bytes = b"documents") -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymize(docs, key)
