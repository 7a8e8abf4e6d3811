"""Surrogates: keyed, type-consistent replacements of personal data, checked over the whole corpus.

Every mention is taken apart into what is kept (separators, particles, titles of streets, country codes)
and into words of a space of their own: email, phone, id_number, street_address, given, family.  Each word of a
space has one surrogate for the whole corpus and no two words share one, so that short and full forms of a
name stay together ("Anna Kohl", "Dr. Kohl", "KOHL, Anna") and different people stay apart.  An initial
stands for the given name with which the same family name is written out in the same text, if there is just one.

A surrogate never is a known name part nor a word of its space anywhere in the texts: in particular not the
original.  Names are made from syllables of the word's script; a given name ends as its gender asks, which
is told by titles and pronouns beside its mentions and by a list of common names, by majority over the
corpus, and else is neutral.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch, spread
from .pii import _PARTICLE, _TYPE, _UNIT, ADDRESS, EMAIL, FEMALE, ID, KINDS, MALE, NAME, PHONE, Finder, _finder, _HAN_FAMILY, _plain, name_parts, replace

GIVEN, FAMILY = "given", "family"
#: Mentions of one word from which on they are spread over several tasks.
HOT = 1_000_000

_SPELT = re.compile(r"[ ]?\((?:at|dot)\)[ ]?|[ ]?\[(?:at|dot)\][ ]?|[ ](?:at|dot)[ ]", re.I)
_KEPT = re.compile(rf"(?:{_TYPE}|{_UNIT}|[nsew]|via|viale|piazza|corso|calle|avenida|plaza|rue|de|la|del|della|des|du|da)$", re.I)
_ENDING = re.compile(r"(strasse|straße|str|weg|gasse|platz|allee|ufer|damm|ring|straat|laan|gatan|vej|veien)$", re.I)
_SMALL = re.compile(rf"{_PARTICLE}$", re.I)
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|.", re.S)
_HAN_PARTS = re.compile(rf"({_HAN_FAMILY})(.*)")
_MR, _MS = re.compile(r"\b(?:mr|herr|sir|signor|monsieur|señor)\.?[ ]$", re.I), re.compile(r"\b(?:ms|mrs|miss|frau|madam|signora|madame|señora)\.?[ ]$", re.I)
_HE, _SHE = re.compile(r"\b(?:he|his|him|himself)\b", re.I), re.compile(r"\b(?:she|her|hers|herself)\b", re.I)
#: Country codes of one and two digits (fixed values); the others have three.
_CODE = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")


class _Stream:
    """Keyed numbers for one word and attempt."""

    def __init__(self, key: bytes, *of: object):
        self.key, self.of, self.n, self.left = key, "\x1f".join(map(str, of)).encode("utf-8", "replace"), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.of + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.left = self.left[:4], self.left[4:]
        return int.from_bytes(x, "big") % n

    def of_(self, choices) -> str:
        return choices[self.below(len(choices))]


# -- taking mentions apart ---------------------------------------------------------------
def _phone(found: str) -> str:
    digits = re.sub(r"\D", "", found)
    return "+" + digits if found.lstrip("(").startswith("+") else "+" + digits[2:] if digits.startswith("00") else digits


def _plain_entity(kind: str, found: str) -> str:
    """What a mention other than a name refers to, however it is written."""
    if kind == EMAIL:
        return _SPELT.sub(lambda m: "@" if "at" in m[0].lower() else ".", found).lower()
    if kind == PHONE:
        return _phone(found)
    if kind == ID:
        return re.sub(r"[^0-9a-z]", "", found.lower())
    return _plain(" ".join(found.lower().split()))


def _name_parts(found: str, titled: bool, kinds: dict[str, str]) -> list[tuple[str, str, str]]:
    """(as written, space or '' where it is kept, word) of a name; initials have the space 'initial'."""
    if han := _HAN_PARTS.fullmatch(found):
        return [(han[1], FAMILY, han[1])] + ([(han[2], GIVEN, han[2])] if han[2] else [])
    pieces = _WORDS.findall(found)
    names = [i for i, w in enumerate(pieces) if w[0].isalpha() and not (i and _SMALL.match(w) and w.islower())]
    comma = found.find(", ")
    # words joined by a hyphen are one place in the name
    groups: list[list[int]] = []
    for i in names:
        if groups and i - groups[-1][-1] == 2 and pieces[i - 1] == "-":
            groups[-1].append(i)
        else:
            groups.append([i])
    out = [(w, "", "") for w in pieces]
    at = [0]
    for w in pieces:
        at.append(at[-1] + len(w))
    for n, group in enumerate(groups):
        if comma >= 0:
            space = FAMILY if at[group[0]] < comma else GIVEN
        elif len(groups) > 1:
            space = FAMILY if n == len(groups) - 1 else GIVEN
        else:
            space = kinds.get(_plain(pieces[group[0]].lower()), FAMILY if titled else GIVEN)
        for i in group:
            w = pieces[i]
            initial = len(w) == 1 and pieces[i + 1 : i + 2] == ["."] and space == GIVEN
            out[i] = (w, "initial" if initial else space, _plain(w.lower()))
    return out


def take_apart(text: str, finder: Finder) -> list[tuple[int, int, str, str, list[tuple[str, str, str]], str]]:
    """(start, end, kind, found, parts, gender) of every mention in a text."""
    out, full = [], {}
    for a, b, kind in finder.find(text):
        found, gender = text[a:b], ""
        if kind != NAME:
            out.append([a, b, kind, found, [(found, kind, _plain_entity(kind, found))], gender])
            continue
        before, after = text[max(0, a - 12) : a], re.split(r"[.!?\n]", text[b : b + 80])[0]
        gender = "m" if _MR.search(before) else "f" if _MS.search(before) else ""
        if not gender and bool(he := _HE.search(after)) != bool(_SHE.search(after)):
            gender = "m" if he else "f"
        titled = bool(re.search(r"[^\W\d_]\.[ ]$", before)) or bool(gender)
        parts = _name_parts(found, titled, finder.names)
        given = [w for _, s, w in parts if s == GIVEN]
        for w in (w for _, s, w in parts if s == FAMILY):
            if given:
                full.setdefault(w, set()).add(given[0])
        out.append([a, b, kind, found, parts, gender])
    for m in out:  # initials stand for the one name that is written out beside the same family name, or for themselves
        family = next((w for _, s, w in m[4] if s == FAMILY), "")
        for i, (lit, space, word) in enumerate(m[4]):
            if space == "initial":
                meant = [g for g in full.get(family, ()) if g.startswith(word)]
                m[4][i] = (lit, GIVEN, meant[0]) if len(meant) == 1 else (lit, "initial", f"{word} {family}")
    return out


# -- making surrogates ---------------------------------------------------------------------
_ONSETS = "b br c d dr f g gr h j k kl l m n p r s st t tr v w z".split()
_VOWELS = "aeiou"
_CODAS = ("", "", "", "l", "n", "r", "s")
_ENDINGS = {"f": ("a", "ia", "ina", "elle", "ette"), "m": ("o", "us", "an", "ert", "on"), "": ("e", "is", "y", "en"), FAMILY: ("berg", "mann", "ov", "er", "son", "ik", "ard", "ell")}
_CYRILLIC = dict(zip("abcdefghijklmnoprstuvwyz", "абкдефгхийклмнопрстувызц"[:24]))
_GREEK = dict(zip("abcdefghijklmnoprstuvwyz", "αβκδεφγχιξκλμνοπρστυβωυζ"))
_HAN_SYLLABLES = "安邦博昌春达德东恩芳飞刚光贵海豪浩宏华建健杰静军俊凯兰磊丽良亮琳玲美敏明娜宁鹏萍平琪强晴庆荣瑞山胜淑涛婷伟文霞祥晓欣秀雪雅艳阳怡英勇玉远月云泽珍志忠"
_HAN_FAMILIES = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧"
_KANA = "アイウエオカキクケコサシスセソタチツテトナニノハヒフマミメモヤユヨラリルレロワ"


def _letters(word: str, s: _Stream) -> str:
    """Another word of the same length, script and case: vowels for vowels, consonants for consonants, digits for digits."""
    out = []
    for c in word:
        low = c.lower()
        if c.isdigit() and c.isascii():
            new = str(s.below(10))
        elif low in _VOWELS:
            new = _VOWELS[s.below(5)]
        elif "a" <= low <= "z":
            new = "bcdfghjklmnprstvwz"[s.below(18)]
        elif c.isalpha():
            base = ord(c) & ~0x0F
            near = [chr(x) for x in range(base, base + 16) if chr(x).isalpha() and chr(x).isupper() == c.isupper()]
            new = near[s.below(len(near))] if near else c
        else:
            new = c
        out.append(new.upper() if c.isupper() else new)
    return "".join(out)


def _name(word: str, ending: str, attempt: int, s: _Stream) -> str:
    """A name of syllables in the script of a word; longer ones after many attempts, so that there always are more."""
    more = attempt // 4
    first = next((c for c in word if c.isalpha()), "a")
    if "\u4e00" <= first <= "\u9fff":
        if ending == FAMILY and not more:
            return s.of_(_HAN_FAMILIES)
        return (s.of_(_HAN_FAMILIES) if ending == FAMILY else "") + "".join(s.of_(_HAN_SYLLABLES) for _ in range(min(2, len(word)) + more))
    if "\u3040" <= first <= "\u30ff":
        made = "".join(s.of_(_KANA) for _ in range(max(2, min(4, len(word))) + more))
        return made if first >= "\u30a0" else "".join(chr(ord(c) - 0x60) for c in made)
    if not ("a" <= _plain(first) <= "z" or "\u0370" <= first <= "\u03ff" or "\u0400" <= first <= "\u052f"):
        return _letters(word, s) + _letters(word[:1], s) * more
    made = "".join(s.of_(_ONSETS) + s.of_(_VOWELS) for _ in range(1 + more)) + s.of_(_ONSETS) + s.of_(_CODAS)
    made = (made if made[-1] not in "aeiou" else made[:-1]) + s.of_(_ENDINGS[ending])
    table = _GREEK if "\u0370" <= first <= "\u03ff" else _CYRILLIC if "\u0400" <= first <= "\u052f" else None
    return "".join(table.get(c, c) for c in made) if table else made


def surrogate(space: str, word: str, gender: str, attempt: int, key: bytes) -> str:
    """The replacement of a word at an attempt."""
    s = _Stream(key, space, word, attempt)
    longer = "".join(str(s.below(10)) for _ in range(attempt // 8))
    if space == GIVEN:
        return _name(word, gender, attempt, s)
    if space == FAMILY:
        return _name(word, FAMILY, attempt, s)
    if space == EMAIL:
        head, _, last = word.rpartition(".")
        return f"{longer}{_letters(head, s)}.{last}"
    if space == PHONE:
        keep = 1 + len(_CODE.match(word, 1)[0]) if word.startswith("+") and _CODE.match(word, 1) else 1 if word[:1] in ("0", "1") else 0
        return word[:keep] + _letters(word[keep:], s) + longer
    if space == ADDRESS:
        return " ".join(w if _KEPT.match(w.strip(".,")) else (lambda m: _letters(w[: m.start()], s) + w[m.start() :] if m and m.start() else _letters(w, s))(_ENDING.search(w)) for w in word.split(" ")) + longer
    return _letters(word, s) + longer


def _cased(new: str, old: str) -> str:
    if old.isupper() and (len(old) > 1 or len(new) == 1):
        return new.upper()
    return new if old.islower() else new[:1].upper() + new[1:]


def render(kind: str, parts: list[tuple[str, str, str]], known: dict[tuple[str, str], str], key: bytes) -> str:
    """A mention in its own format: separators, order, case and initials stay; what has no surrogate becomes a placeholder."""
    out = []
    for lit, space, word in parts:
        if not space:
            out.append(lit)
        elif space == "initial":  # per family name another letter for each, never itself
            letter, _, family = word.partition(" ")
            if not "a" <= letter <= "z":
                return f"[{kind.upper()}]"
            out.append(_cased(chr(97 + (ord(letter) - 96 + _Stream(key, space, family).below(25)) % 26), lit))
        elif (new := known.get((space, word))) is None:
            return f"[{kind.upper()}]"
        elif kind == NAME:
            out.append(_cased(new[:1] if len(lit) == 1 and len(word) > 1 else new, lit))
        elif kind == EMAIL:
            spelt = {("at" in m[0].lower()): m[0] for m in _SPELT.finditer(lit)}
            new = "".join(spelt.get(c == "@", c) if c in "@." else c for c in new)
            out.append("".join(n.upper() if f.isupper() else n for f, n in zip(lit, new)) if len(lit) == len(new) else new)
        elif kind == ADDRESS:
            out.append("".join(n.upper() if f.isupper() else n for f, n in zip(lit, new)) if len(lit) == len(new) else new)
        else:
            fill = list(new.removeprefix("+"))
            if kind == PHONE and new.startswith("+") and not lit.lstrip("(").startswith("+"):
                fill = ["0", "0", *fill]
            places = sum(c.isalnum() and c.isascii() for c in lit)
            rest = "".join(fill[places:])
            fill = iter(fill)
            out.append("".join((lambda n: n.upper() if c.isupper() else n)(next(fill, c)) if c.isalnum() and c.isascii() else c for c in lit) + rest)
    return "".join(out)


# -- over tables ------------------------------------------------------------------------------
_PART = "struct<lit:string,space:string,word:string>"
_MARKS = f"array<struct<a:int,b:int,kind:string,found:string,parts:array<{_PART}>,gender:string>>"


def _marked(texts: DataFrame, names: DataFrame | None, with_text: bool) -> DataFrame:
    """src, rec_id, block_no, marks (and text): the rows with what was found in them; without text only those with any."""
    sent = texts.sparkSession.sparkContext.broadcast(name_parts(names))
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("kind", pa.string()), ("found", pa.string()), ("parts", pa.list_(pa.struct([("lit", pa.string()), ("space", pa.string()), ("word", pa.string())]))), ("gender", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(sent.value)
        for batch in batches:
            marks = []
            for text in batch.column(3).to_pylist():
                found = take_apart(text, finder) if text else []
                marks.append([{"a": a, "b": b, "kind": k, "found": f, "parts": [{"lit": x, "space": y, "word": z} for x, y, z in p], "gender": g} for a, b, k, f, p, g in found])
            at = pa.array([i for i, m in enumerate(marks) if m or with_text], pa.int64())
            cols = [batch.column(i).take(at) for i in range(4 if with_text else 3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([m for m in marks if m or with_text], kind)], ["src", "rec_id", "block_no", *(["text"] if with_text else []), "marks"])

    rows = spread(texts.select("src", "rec_id", "block_no", "text"), "rec_id", "text")
    return rows.mapInArrow(run, f"src string, rec_id bigint, block_no int, {'text string, ' if with_text else ''}marks {_MARKS}")


def surrogates(words: DataFrame, names: DataFrame | None, key: str, most: int = 60) -> DataFrame:
    """space, word, surrogate: one replacement for each row of ``words`` (space, word, gender), all of a space distinct.

    A replacement that two words would share, or that is itself a word of the texts or a known name part, goes to
    the smallest word or to none; the others try the next keyed one.  Later attempts are longer, so that the
    rounds come to an end whatever the number of words; after ``most`` an error is raised.
    """
    spark = words.sparkSession
    scratch = Scratch(spark, "surrogates")
    parts = {_plain(w.lower()) for w in name_parts(names)} | FEMALE | MALE
    sent = spark.sparkContext.broadcast((key.encode(), parts))

    def tried(df: DataFrame, attempt: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            secret, known = sent.value
            for b in batches:
                new = [surrogate(*row, attempt, secret) for row in zip(*(b.column(i).to_pylist() for i in range(3)))]
                ok = [s not in (GIVEN, FAMILY) or n not in known for s, n in zip(b.column(0).to_pylist(), new)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([n if o else None for n, o in zip(new, ok)], pa.string())], ["space", "word", "gender", "surrogate"])

        return df.mapInArrow(run, "space string, word string, gender string, surrogate string")

    done, left = None, words.select("space", "word", "gender")
    taken = words.select(F.when(F.col("space") == FAMILY, GIVEN).otherwise(F.col("space")).alias("kind"), F.col("word").alias("surrogate")).distinct()
    for attempt in range(most):
        made = scratch.save(tried(left, attempt))
        first = Window.partitionBy("space", "surrogate").orderBy("word")
        free = made.where("surrogate is not null").withColumn("kind", F.when(F.col("space") == FAMILY, GIVEN).otherwise(F.col("space"))).join(taken, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        free = scratch.save(free.withColumn("at", F.row_number().over(first)).where("at = 1").select("space", "word", "surrogate"))
        done = free if done is None else done.unionByName(free)
        before, left = left, scratch.save(made.drop("surrogate").join(free, ["space", "word"], "left_anti"))
        scratch.drop(made)
        if attempt:
            scratch.drop(before)
        if left.isEmpty():
            return done
    raise RuntimeError(f"no distinct surrogates after {most} attempts")


def _replaced(marked: DataFrame, names: DataFrame | None, key: str) -> DataFrame:
    """``marked`` (with uid) and a column known: the surrogates of the words of each row (null where it has none)."""
    scratch = Scratch(marked.sparkSession, "pseudonyms")
    mention = marked.select("uid", F.explode("marks").alias("m"))
    part = mention.select("uid", "m.gender", F.explode("m.parts").alias("p")).where("p.space not in ('', 'initial')").select("uid", "p.space", "p.word", "gender")
    votes = part.groupBy("space", "word").agg(F.sum(F.expr("if(gender = 'f', 1, if(gender = 'm', -1, 0))")).alias("f"), F.count("*").alias("n"))
    listed = F.when(F.col("word").isin(*sorted(FEMALE)), 0.5).when(F.col("word").isin(*sorted(MALE)), -0.5).otherwise(0.0)
    lean = F.col("f") + listed
    words = scratch.save(votes.withColumn("gender", F.when((F.col("space") != GIVEN) | (lean == 0), "").when(lean > 0, "f").otherwise("m")))
    made = surrogates(words, names, key)
    part = part.select("uid", "space", "word").distinct()
    # the words with more than HOT mentions are few, as there are at most mentions / HOT of them
    hot = words.where(F.col("n") > HOT).select("space", "word", F.ceil(F.col("n") / HOT).cast("int").alias("salts"))
    if not hot.isEmpty():
        hot = F.broadcast(hot)
        part = part.join(hot, ["space", "word"], "left").withColumn("salt", F.pmod("uid", F.coalesce("salts", F.lit(1)))).drop("salts")
        made = made.join(hot, ["space", "word"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).cast("bigint")).drop("salts")
    on = ["space", "word"] + (["salt"] if "salt" in made.columns else [])
    known = part.join(made, on).groupBy("uid").agg(F.collect_list(F.struct("space", "word", "surrogate")).alias("known"))
    return marked.join(known, "uid", "left")


def _known(rows: list[dict] | None) -> dict[tuple[str, str], str]:
    return {(r["space"], r["word"]): r["surrogate"] for r in rows or ()}


def _parts(mark: dict) -> list[tuple[str, str, str]]:
    return [(p["lit"], p["space"], p["word"]) for p in mark["parts"]]


def pseudonyms(texts: DataFrame, names: DataFrame | None, key: str) -> DataFrame:
    """src, rec_id, block_no, kind, found, start_pos, end_pos, surrogate: every piece of personal data with its replacement.

    As with :func:`with_surrogates`; repeated rows come out each by itself.
    """
    scratch = Scratch(texts.sparkSession, "mentions")
    marked = scratch.save(_marked(texts, names, False).withColumn("uid", F.monotonically_increasing_id()))
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, (marks, known) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                known = _known(known)
                for m in marks:
                    rows.append(i)
                    out.append((m["kind"], m["found"], m["a"], m["b"], render(m["kind"], _parts(m), known, secret)))
            at = pa.array(rows, pa.int64())
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), *(pa.array(c, pa.int32() if i in (2, 3) else pa.string()) for i, c in enumerate(cols))], ["src", "rec_id", "block_no", "kind", "found", "start_pos", "end_pos", "surrogate"])

    both = _replaced(marked, names, key).select("src", "rec_id", "block_no", "marks", "known")
    return both.mapInArrow(run, "src string, rec_id bigint, block_no int, kind string, found string, start_pos int, end_pos int, surrogate string")


def with_surrogates(texts: DataFrame, names: DataFrame | None, key: str) -> DataFrame:
    """src, rec_id, block_no, text: each piece of personal data replaced by its surrogate in the mention's own format.

    Rows are told apart by a number of their own, so that null and repeated ids are no danger: every row comes out
    once.  A mention without a surrogate becomes a placeholder, never the original.  Null and empty texts stay.
    """
    scratch = Scratch(texts.sparkSession, "mentions")
    marked = scratch.save(_marked(texts, names, True).withColumn("uid", F.monotonically_increasing_id()))
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, marks, known in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5))):
                known = _known(known)
                out.append(replace(text, [(m["a"], m["b"], render(m["kind"], _parts(m), known, secret)) for m in marks]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.string())], ["src", "rec_id", "block_no", "text"])

    any_ = F.size("marks") > 0
    both = _replaced(marked.where(any_), names, key).select("src", "rec_id", "block_no", "text", "marks", "known")
    return marked.where(~any_).select("src", "rec_id", "block_no", "text").unionByName(both.mapInArrow(run, "src string, rec_id bigint, block_no int, text string"))


__all__ = ["KINDS", "pseudonyms", "surrogates", "with_surrogates"]
