"""Personal information inside free text: finding it, and replacing it.

Finding reads whole texts with patterns for email addresses, phone numbers, identity numbers and
street addresses, and with known name parts and the words around them for personal names.  A piece
that lies within an earlier kind of piece is no case of its own.

Replacing writes typed placeholders; keyed surrogates are in :mod:`surrogates`.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import spread

EMAIL, PHONE, ID, ADDRESS, NAME = KINDS = ("email", "phone", "id_number", "street_address", "person_name")

# -- email ------------------------------------------------------------------
_DOT = r"(?:\.|[ ]?\(dot\)[ ]?|[ ]?\[dot\][ ]?|[ ]dot[ ])"
_AT = r"(?:[ ]?\(at\)[ ]?|[ ]?\[at\][ ]?|[ ]at[ ](?=[\w-]+[ ]dot[ ]))"
_EMAIL = re.compile(
    rf"[^\W_][\w.+-]*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{{2,}}(?![\w-])"
    rf"|(?:[^\W_][\w+-]*{_DOT})*[^\W_][\w+-]*{_AT}(?:[^\W_](?:[\w-]*[^\W_])?{_DOT})+[^\W\d_]{{2,}}(?![\w-])",
    re.I,
)
_DIGIT = re.compile(r"\d")
_EMAIL_HINT = re.compile(r"@|\(at\)|\[at\]| at ", re.I)

# -- phone ------------------------------------------------------------------
_GAP = r"[ .\-‐-–/ ]"
_PHONE = re.compile(
    rf"(?<![\w.,:/+-])(?:"
    rf"(?:\+|00)[1-9]\d{{0,2}}(?:{_GAP}?\(\d{{1,5}}\){_GAP}?\d+|{_GAP}\d+|\d+)(?:{_GAP}\d+)*"  # with a country code
    rf"|\(0?\d{{2,4}}\){_GAP}?\d{{3,4}}(?:{_GAP}?\d{{2,5}})*"  # area code in brackets
    rf"|[2-9]\d{{2}}({_GAP})\d{{3}}\1\d{{4}}"
    rf"|0\d{{2,4}}{_GAP}\d{{3,4}}{_GAP}?\d{{3,4}}"
    rf"|[2-9]\d{{2}}[2-9]\d{{6}}"
    rf"|1[3-9]\d({_GAP})\d{{4}}\2\d{{4}}"  # mobile numbers of eleven digits
    rf")(?![\w-]|[.,:/]\d)"
)
_SHORT_PHONE = re.compile(rf"\b(?:call|text|tel|phone|fax|whatsapp|mobile|cell|number is|desk under)\b\W{{0,3}}(?:me at |us at )?([\d(][\d ()\-.]{{5,}}\d)(?![\w-]|[.,:/]\d)", re.I)

# -- identity numbers ---------------------------------------------------------
_LABEL = (
    r"(?:ssn|social security|passport|national id(?:entity)?|identity|identification|id[ -]card|id[ -](?:no|number)|tax(?:payer)?|driv(?:er|ing)(?:'s|s)? licen[cs]e|licen[cs]e)"
    r"(?:[ -](?:card|id|identification|number|no|nr|num))*"
)
_VALUE = (
    r"(?:\d{3}[- ]\d{2}[- ]\d{4}|[A-Z]{2}( ?)\d{2}\2\d{2}\2\d{2}\2[A-Z](?![\w-])|\d{2} \d{3} \d{3} \d{3}|[A-Z](?:-\d{3}){3}|\d{6}/\d{3,4}|\d{2}-\d{7}"
    r"|[A-Z]\d{2}[A-Z]\d{5}|[A-Z]{0,2}\d{6,12}[A-Z]?|(?=[A-Z0-9/-]*\d{3})[A-Z0-9]+(?:[-/][A-Z0-9]+)*)"
)
_ID = re.compile(rf"\b{_LABEL}[\"']?(?:[ ]?[.:=#][ ]?|[ ]is[ ]|[ ])(?:#|no\.?[ ]?)?[\"'(]?({_VALUE})(?![\w-])", re.I)
_SSN = re.compile(r"(?<![\w.+/-])\d{3}([- ])\d{2}\1\d{4}(?![\w-]|[.,/]\d)")

# -- street addresses -----------------------------------------------------------
_TYPE = r"(?:street|str|st|avenue|ave|road|rd|lane|ln|way|drive|dr|boulevard|blvd|court|ct|place|pl|square|sq|terrace|close|crescent|parkway|pkwy|row|walk|hill)"
_UNIT = r"(?:flat|apt|apartment|suite|unit|ste|no|#)"
_STREET_WORD = r"[^\W\d_][^\W\d_'’-]*"
_SUFFIX = rf"(?:,?[ ]{_UNIT}\.?[ ]?\d+[a-z]?(?!\w))?"
_NUMBER = re.compile(r"(?<![\w.-])\d{1,5}[A-Za-z]?(?![\w-]|[.:/]\d)")
#: From the house number on, and what a flat before it looks like.
_HOUSE_FIRST = re.compile(
    rf"\d+[a-z]?,?[ ](?:[NSEW]\.?[ ]|[NS][EW]\.?[ ])?(?:{_STREET_WORD}|(?-i:[A-Z]{_STREET_WORD}(?:[ ][A-Z]{_STREET_WORD}){{1,2}}))[ ]{_TYPE}(?![\w-])\.?{_SUFFIX}", re.I
)
_FLAT = re.compile(rf"(?<![\w.-]){_UNIT}\.?[ ]?\d+[a-z]?,?[ ]$", re.I)
#: Up to the house number, where it stands last.
_HOUSE_LAST = re.compile(
    rf"(?<![\w.-])(?:{_UNIT}\.?[ ]?\d+[a-z]?,?[ ])?(?:"
    rf"(?:via|viale|piazza|corso|calle|avenida|plaza|paseo|rue|avenue|boulevard|place|rua|ulica)(?:[ ](?:de la|de los|de las|de|del|della|des|du|da|do|la|le|el))?(?:[ ](?-i:[A-Z]){_STREET_WORD}){{1,3}}"
    rf"|{_STREET_WORD}(?:strasse|straße|str\.|weg|gasse|platz|allee|ufer|damm|ring|straat|laan|gatan|vej|veien)"
    rf"),?[ ]$",
    re.I,
)
_TAIL = re.compile(_SUFFIX, re.I)
_LONGEST_NAME = 90


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _NUMBER.finditer(text):
        if first := _HOUSE_FIRST.match(text, m.start()):
            flat = _FLAT.search(text, max(0, m.start() - 20), m.start())
            yield flat.start() if flat else m.start(), first.end()
        elif text[m.start() - 1 : m.start()] == " " and len(m[0].rstrip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")) <= 4:
            if street := _HOUSE_LAST.search(text, max(0, m.start() - _LONGEST_NAME), m.start()):
                yield street.start(), _TAIL.match(text, m.end()).end()


# -- names ------------------------------------------------------------------------
#: English words that are also names: they count in a name's surroundings or beside another name only.
COMMON = frozenset(
    "will mark grace stone hale brook marsh drew rose field brand briar broth may june april august hope faith joy dawn art bill bob chip chase clay cliff dale dean "
    "drake earl ernest forest forrest frank gene glen guy harmony heath holly hunter iris ivy jack jade jean jewel lane lily lance major mason max miles mercy miller "
    "pat pearl penny piper ray reed rich rob rusty ruby rock sandy sage skip sky sterling summer sue tanner trip van victor violet wade ward wells west woods wood young "
    "black white brown green gray grey king knight page park price banks bell best bishop bond booth burns bush carpenter case cash church cook cross day early english "
    "fish fisher ford fox frost gates gold hall hand hart hill holmes hood house hunt keys lake law long love low marks moss nice north park parks pool pope power rivers "
    "sharp short silver small snow stark steel strong sun swift temple walker wall waters weaver wise wolf".split()
)
TITLES = r"(?:dr|mr|mrs|ms|mx|prof|professor|sir|madam|doctor|herr|frau)"
_PART = r"[^\W\d_]+(?:['’][^\W\d_]+)?(?:-[^\W\d_]+(?:['’][^\W\d_]+)?)*"
_CAP = rf"(?:(?-i:[A-ZÀ-ÞĀ-ɏͰ-ϿЀ-Я])(?:{_PART}|(?=\.)))"
_INITIAL = r"(?-i:[A-ZÀ-Þ])\."
_PARTICLE = r"(?:van|von|de|del|della|di|da|dos|al|el|bin|ibn|la|le|ter|ten)"
_FULL = rf"(?:{_INITIAL}[ ]?)*{_CAP}(?:[ ](?:{_INITIAL}(?:[ ]|(?=[ ]))?)?(?:{_PARTICLE}[ ])?{_CAP}){{0,2}}"
_RUN = re.compile(rf"(?<![\w@.-])(?:{_INITIAL}[ ]?)*{_CAP}(?:(?:[ ]{_INITIAL})*(?:[ ]{_PARTICLE})?[ ]{_CAP})*(?![\w@])")
_LASTFIRST = re.compile(rf"\b(?:assigned to|owner:?|author:?|reviewer:?|by|name:?|contact:?)[ ]({_CAP}(?:-{_CAP})?,[ ]{_CAP}(?:[ ]{_INITIAL})?)(?=[;.,)]|[ ]|$)", re.I)
_TITLED = re.compile(rf"\b{TITLES}\.?[ ]({_FULL})(?![\w@])", re.I)
#: What stands before a name, and after it where the words before it are not enough (fixed values).
_BEFORE = re.compile(
    rf"\b(?:reviewed by|signed by|approved by|written by|reported by|paired with|talk to|spoke to|assigned to|blame says|good catch,|my name is|i am|"
    rf"(?:kind |best |warm )?regards,|cheers,|sincerely,|yours,|dear|hi|hello|hey|thanks,|thank you,|signed,|contact:|name:|cc:|per|ask|from|this is|owner)[ ]({_FULL})(?![\w@])",
    re.I,
)
_WEAK = frozenset(("i am", "per", "ask", "from", "this is", "owner", "contact:", "talk to", "hi", "hello", "hey", "dear", "cc:", "name:"))
_AFTER = re.compile(r"[ ]?(?:,[ ]who\b|,[ ]two years|:[ ]do not|owns\b|signed it\b|about the\b|first\b|\(see\b|,[ ]see below|,[ ]thanks|on the fix|today\b|wrote\b|said\b|reported\b|joined\b|left the\b)|[ ]?[!.]?(?:$|\n)|\.[ ]", re.I)
_OWNS = re.compile(rf"(?<![\w@.-])({_FULL})[ ](?:owns this|signed it off)\b")
_THANKS = re.compile(rf"(?:--|—|–)[ ]?({_PART}(?:[ ]{_PART})?)(?![\w@])")
#: Common given names by gender (fixed values): known parts besides those of the table, none of them an English word.
FEMALE = frozenset("anna anne maria mary elena laura sofia sophia julia emma emily olivia sarah sara hannah lisa linda barbara susan jennifer jessica nancy karen helen sandra claudia monika ursula ingrid chiara giulia francesca carmen lucia isabel camille chloe amelie ines fatima aisha leila priya ananya lakshmi mei yuki sakura keisha amina ngozi olga natasha tatiana svetlana irina katarzyna agnieszka zofia".split())
MALE = frozenset("john james robert michael david william richard thomas joseph charles christopher daniel matthew anthony paul steven andrew kenneth george kevin brian edward ronald timothy jason jeffrey peter hans klaus stefan wolfgang dieter marco luca giovanni alessandro carlos jorge miguel jose pedro pierre jacques francois ahmed mohammed omar ali hassan raj arjun rahul vikram hiroshi kenji takashi kwame chidi ivan dmitri sergei vladimir piotr tomasz krzysztof".split())
#: Family names in Han script (fixed values), and what follows a name there.
_HAN_FAMILY = "田中|鈴木|佐藤|高橋|伊藤|渡辺|山本|中村|小林|加藤|吉田|山田|佐々木|山口|松本|井上|木村|清水|[王李张張刘劉陈陳杨楊赵趙黄黃周吴吳徐孙孫胡朱高林何郭马馬罗羅梁宋郑鄭谢謝韩韓唐冯馮于董萧蕭程曹袁邓鄧许許傅沈曾彭吕呂苏蘇卢盧蒋蔣蔡贾賈丁魏薛叶葉阎余潘杜戴夏钟鐘汪任姜范方石姚谭譚廖邹鄒熊金陆陸郝孔白崔康毛邱秦江史顾顧侯邵孟龙龍万段雷钱錢汤湯尹黎常武乔喬贺賀赖賴龚龔]"
_HAN_NAME = re.compile(rf"(?:{_HAN_FAMILY})[\u4e00-\u9fff々]{{0,3}}?(?=さん|様|氏|先生|女士|小姐|老师|君)|(?<![\u3040-\u30ff\u4e00-\u9fff々])(?:{_HAN_FAMILY})[\u4e00-\u9fff]{{1,2}}(?![\u3040-\u30ff\u4e00-\u9fff々])")
_HAN = re.compile("[\u4e00-\u9fff]")
_STOP = frozenset(
    "the a an i it we you he she they this that these those my our your his her their what why how when where who which there here no not yes ok let lets can could would should did do done does is are was were "
    "and or but if then so because for from to in on at by of with per ask talk dear hi hello hey thanks thank kind best regards cheers owner author contact cc re fwd dr mr mrs ms prof sir row form fax tel call text "
    "whatsapp reach pick ship site address ssn passport national id identity tax driver social please running open all team everyone folks customer reader madam commit ticket build elapsed checksum good reviewed signed paired blame also now".split()
)


class Finder:
    """Finds the pieces of one text; ``names`` are known parts of names, kind by lower-case word."""

    def __init__(self, names: dict[str, str]):
        self.names = dict.fromkeys(FEMALE | MALE, "given") | {w.lower(): k for w, k in names.items() if w}
        self.sure = frozenset(w for w in self.names if w not in COMMON)

    def known(self, part: str, sure: bool = True) -> bool:
        held = self.sure if sure else self.names
        return any(p in held for p in re.split("[-'’]", _plain(part.lower())))

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        """(start, end, kind) in order, without overlaps."""
        if not text:
            return []
        taken: list[tuple[int, int, str]] = []

        def take(a: int, b: int, kind: str) -> None:
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, kind))

        if _EMAIL_HINT.search(text):
            for m in _EMAIL.finditer(text):
                take(*m.span(), EMAIL)
        if _DIGIT.search(text):
            for m in _ID.finditer(text):
                if sum(c.isdigit() for c in m[1]) >= 4:
                    take(*m.span(1), ID)
            for m in _SSN.finditer(text):
                take(*m.span(), ID)
            for span in _addresses(text):
                take(*span, ADDRESS)
            for m in _PHONE.finditer(text):
                n = sum(c.isdigit() for c in m[0])
                if (11 if m[0].startswith("00") and m[0].isdigit() else 9) <= n <= 15:
                    take(*m.span(), PHONE)
            for m in _SHORT_PHONE.finditer(text):
                if 7 <= sum(c.isdigit() for c in m[1]) <= 15:
                    take(*m.span(1), PHONE)
        self._names(text, take)
        return sorted(taken)

    def _names(self, text: str, take) -> None:
        for m in _LASTFIRST.finditer(text):
            a, b = m[1].split(", ", 1)
            if self.known(a, False) or self.known(b, False) or m[0].lower().startswith("assigned"):
                take(*m.span(1), NAME)
        for m in _BEFORE.finditer(text):
            self._cued(text, m, take)
        for m in _THANKS.finditer(text):
            parts = m[1].split(" ")
            good = [self.known(p, False) for p in parts]
            if good[0]:
                end = m.end(1) if len(parts) > 1 and (good[1] or parts[1][0].islower()) else m.start(1) + len(parts[0])
                take(m.start(1), end, NAME)
            elif len(parts) > 1 and good[1] and parts[0].lower() not in _STOP:
                take(*m.span(1), NAME)
        for m in _OWNS.finditer(text):
            words = m[1].split(" ")
            if words[0].lower() not in _STOP and (len(words) > 1 or words[0].lower() not in COMMON or self.known(words[0], False)):
                take(*m.span(1), NAME)
        for m in _TITLED.finditer(text):
            words = m[1].split(" ")
            if words[0].lower().strip(".") not in _STOP:
                take(m.start(1), self._end(m, words), NAME)
        if _HAN.search(text):
            for m in _HAN_NAME.finditer(text):
                take(*m.span(), NAME)
        for m in _RUN.finditer(text):
            for a, b in self._known_runs(m):
                take(a, b, NAME)

    def _end(self, m: re.Match, words: list[str]) -> int:
        """Where the name of a match ends: words that are neither known nor the first two are left out."""
        keep = 0
        for k, w in enumerate(words):
            if k and w.lower() in _STOP or k and w.lower() in ("i", "a"):
                break
            keep = k + 1
        return m.start(1) + len(" ".join(words[:keep]))

    def _foreign(self, words: list[str]) -> bool:
        """Whether the last of several words rather starts what follows the name."""
        last = words[-1].lower()
        if re.split("['’]", last)[0] in _STOP:
            return True
        whole = [w for w in words if not w.endswith(".") and w not in ("van", "von", "de", "del", "di", "da")]
        return len(whole) > 2 and not self.known(last)

    def _cued(self, text: str, m: re.Match, take) -> None:
        words = m[1].split(" ")
        if words[0].lower() in _STOP:
            return
        keep = list(words)
        while len(keep) > 1 and self._foreign(keep):
            keep.pop()
        name = " ".join(keep)
        end = m.start(1) + len(name)
        cue = text[m.start() : m.start(1)].strip().lower()
        parts = [w for w in keep if len(w) > 2 or not w.endswith(".")]
        if any(self.known(p) for p in parts) or (cue not in _WEAK) or (len(parts) >= 2 and (cue == "this is" or any(self.known(p, False) for p in parts) or _AFTER.match(text, end))):
            take(m.start(1), end, NAME)
        elif len(parts) == 1 and (self.known(parts[0], False) and _AFTER.match(text, end) or cue in ("hi", "hello", "hey", "dear") and text[end : end + 1] == "," and name.lower() not in COMMON):
            take(m.start(1), end, NAME)

    def _known_runs(self, m: re.Match) -> Iterator[tuple[int, int]]:
        """Within a run of capitalised words, the stretches that are names by the known parts."""
        words = [(w.start() + m.start(), w[0]) for w in re.finditer(r"[^ ]+", m[0])]
        flat, k = [], 0
        for at, w in words:
            initial = len(w) == 2 and w[1] == "."
            flat.append((at, w, "i" if initial else "s" if w.lower() in _STOP else "k" if self.known(w) else "c" if self.known(w, False) else "u"))
        while k < len(flat):
            if flat[k][2] == "s":
                k += 1
                continue
            e = k
            while e < len(flat) and flat[e][2] != "s":
                e += 1
            part = flat[k:e]
            sorts = "".join(x[2] for x in part)
            start, stop = 0, len(part)
            if "k" in sorts or "cc" in sorts:
                # unknown words at the edges stay only next to a known one
                first = min((sorts.find(x) for x in ("k", "c") if x in sorts))
                last = max(sorts.rfind("k"), sorts.rfind("c"))
                start = first
                while start > 0 and sorts[start - 1] == "i":
                    start -= 1
                if start > 0 and sorts[start - 1] == "u" and last == first and not any(ch == "i" for ch in sorts[start:first]):
                    start -= 1
                stop = last + 1
                if stop < len(sorts) and sorts[stop] == "u" and last == first and start == first:
                    stop += 1
                end = part[stop - 1][0] + len(part[stop - 1][1])
                yield part[start][0], end
            k = e


_FOLD = str.maketrans("àáâãäåāçčèéêëēìíîïīñòóôõöōøùúûüūýÿšž", "aaaaaaacceeeeeiiiiinooooooouuuuuyysz")


def _plain(word: str) -> str:
    return word.translate(_FOLD)


# -- over tables ----------------------------------------------------------------------

#: Known name parts are sent to every task, so their number is bounded.
MAX_NAME_PARTS = 1_000_000


def name_parts(names: DataFrame | None) -> dict[str, str]:
    """word -> kind of a table of name parts (word, word_kind), which must be of bounded size."""
    if names is None:
        return {}
    n = names.count()
    if n > MAX_NAME_PARTS:
        raise ValueError(f"{n} name parts; at most {MAX_NAME_PARTS} are supported")
    return {w: k or "given" for w, k in sorted((tuple(r) for r in names.select("word", "word_kind").where("word is not null").collect()), key=str)}


def message_texts(lines: DataFrame | None, quotes: DataFrame | None) -> DataFrame:
    """src, rec_id, block_no, text: the free texts of session lines and quotes, null and empty ones left out."""
    parts = []
    if lines is not None:
        block = F.transform("message.blocks", lambda b, i: F.struct((i + 1).cast("int").alias("no"), b["text"].alias("text")))
        all_ = F.concat(F.array(F.struct(F.lit(0).alias("no"), F.col("message.content").alias("text"))), F.coalesce(block, F.array().cast("array<struct<no:int,text:string>>")))
        parts.append(lines.select(F.lit("session_lines").alias("src"), F.col("row_id").alias("rec_id"), F.explode(F.filter(all_, lambda b: b["text"] != "")).alias("b")).select("src", "rec_id", F.col("b.no").alias("block_no"), "b.text"))
    if quotes is not None:
        parts.append(quotes.where("text <> ''").select(F.lit("quotes").alias("src"), F.col("quote_id").alias("rec_id"), F.lit(0).alias("block_no"), "text"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _finder(parts: dict[str, str]) -> Finder:
    return _held(tuple(parts.items()))


@lru_cache(maxsize=2)
def _held(items: tuple) -> Finder:
    return Finder(dict(items))


def find_pii(texts: DataFrame, names: DataFrame | None) -> DataFrame:
    """src, rec_id, block_no, kind, found, start_pos, end_pos: every piece of personal data, as it stands in the text.

    Texts are read whole, however long; null and empty ones hold nothing.  Repeated rows are each
    searched; an empty table gives no rows.
    """
    sent = texts.sparkSession.sparkContext.broadcast(name_parts(names))
    columns = ["src", "rec_id", "block_no", "kind", "found", "start_pos", "end_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(sent.value)
        for batch in batches:
            rows, out = [], []
            for k, text in enumerate(batch.column(3).to_pylist()):
                for a, b, kind in finder.find(text):
                    rows.append(k)
                    out.append((kind, text[a:b], a, b))
            at = pa.array(rows, type=pa.int64())
            cols = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], columns)

    return spread(texts.select("src", "rec_id", "block_no", "text"), "rec_id", "text").mapInArrow(run, "src string, rec_id bigint, block_no int, kind string, found string, start_pos int, end_pos int")


def with_placeholders(texts: DataFrame, names: DataFrame | None) -> DataFrame:
    """src, rec_id, block_no, text: each piece replaced by a placeholder of its type such as [EMAIL], the rest unchanged."""
    sent = texts.sparkSession.sparkContext.broadcast(name_parts(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(sent.value)
        for batch in batches:
            out = [replace(t, [(a, b, f"[{kind.upper()}]") for a, b, kind in finder.find(t)]) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.string())], ["src", "rec_id", "block_no", "text"])

    return spread(texts.select("src", "rec_id", "block_no", "text"), "rec_id", "text").mapInArrow(run, "src string, rec_id bigint, block_no int, text string")


def replace(text: str | None, spans: Iterable[tuple[int, int, str]]) -> str | None:
    out, last = [], 0
    for a, b, new in sorted(spans):
        out += [text[last:a], new]
        last = b
    return text if not out else "".join(out) + text[last:]
