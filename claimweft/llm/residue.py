"""Problem 2: template residue, filler and error pages in place of content.

Records of one template agree in everything but their slots. Each sentence is reduced to its skeleton: names, numbers,
addresses and units in marks are slots, the rest is fixed text; sentences of the same skeleton are thereby aligned, and
what their slots hold is compared across all records. No list of phrases or of variable names is used.

* Unfilled slots. A unit in marks, or a blank, has a form ("{{w}}", "%w%", "[w w w]", "X+"). A form is induced as that of a
  variable, default or blank where it stands in slots that other records of the same template fill with names or numbers:
  in ``ALIGNED`` slots at least, and in ``ALIGNED_SHARE`` of all slots that it stands in. A record that holds such a form is
  residue, unless a short quotation shows it ("Dear {{name}}", as a report has it).
* Error templates and filler. Fixed text is strange where its words aren't those of prose. A template of strange fixed text
  whose slots vary from record to record is a report on such things; one that comes with the same words wherever it
  recurs, on ``RECURS`` addresses at least, is whole template text, and the capitalised words that it repeats are known as
  fixed text in sentences that are too rare to be aligned. A strange sentence without two varying names is a notice.

A snippet is a case where notices are most of its words. A page is a case where of what the block labeller keeps as its
article hardly anything but notices is left. Pages and snippets are aligned apart, so that neither changes the other.

Cases: null, empty and blank texts are no case; repeated records are each reported, but one address counts once; a text of
any length is read whole; an empty table gives no rows; extra columns are ignored; without an address every record counts
as one of its own. A language of which the prose has nothing is strange throughout: give prose of every language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweft.llm.blocks import BlockLabeller, Reader, label_batch
from claimweft.llm.lang import SURE, Detector, LanguageCode

#: Words of prose that are kept, the most frequent ones, and how often a word must occur.
PROSE_WORDS, PROSE_LEAST = 100_000, 3
#: Share of words that prose doesn't have, from which on fixed text is strange, and from which on it is worth aligning.
STRANGE, ALIGN_FROM = 0.25, 0.2
#: Slots, and the share of all slots of a form, that must be filled elsewhere; fixed words that a template has at least.
ALIGNED, ALIGNED_SHARE, FIXED_WORDS = 3, 0.05, 3
#: Addresses on which a template or one of its words must recur; a slot of so many values for its addresses varies.
RECURS, VARIES, VARIES_SHARE = 3, 3, 0.5
#: Sentences of fewer words that aren't strange say nothing either way ("Sorry!", "Back to the start").
NEUTRAL_WORDS = 5
#: What stays of an article on a page that has none: words at most, or a multiple of the notices.
PAGE_WORDS, PAGE_SHARE = 15, 1.2
MEMO = 300_000

_SENTENCE_END = re.compile(r"[.!?…][”»“\"’')\]]*\Z")
_BRACKETS = re.compile(r"\{[^{}\n]{1,60}\}|\[[^\[\]\n]{1,60}\]|<[^<>\n]{1,60}>")
_QUOTED = re.compile(r"[“„«\"‘]([^“”„«»\"‘’]{1,60})[”“»\"’]")
_TRIM = ".,;:!?…\"“”„‘’'()¿¡–—-"
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[^\W\d_]+(?:[._]+[^\W\d_]+)*")
#: Marks that stand in prose without making a unit of their own.
_PLAIN_MARKS = frozenset(".,;:!?…\"“”„‘’'()¿¡–—-/&*+~`|•·©%€$£#")
#: Fill characters of blanks, and the words of programming languages for a value that isn't set.
_BLANK = re.compile(r"([Xx_?])\1{2,}")
_UNSET = frozenset({"undefined", "NaN"})
BLANK_JOIN = ""


def form_of(core: str) -> str | None:
    """The form of a unit in marks, or of a blank; none of any other token. Letters of a name are w, digits 0."""
    if _BLANK.fullmatch(core):
        return core[0] + "+"
    if core in _UNSET:
        return core
    printf = core.startswith("%(") and core[-2:-1] == ")"
    if len(core) > 80 or core[0].isalnum() or not printf and core[-1].isalnum() or not any(c.isalpha() for c in core):
        return None
    if core[0] in _PLAIN_MARKS and not printf and not (core[0] in "#%$" and core[-1] in "#%})"):
        return None
    return re.sub(r"\d+", "0", _NAME.sub("w", core)).replace(BLANK_JOIN, " ")


class Token(NamedTuple):
    kind: str  # word, name, slot, form, or nothing for marks
    digest: bytes
    core: str
    form: str | None
    words: int
    strange: int
    ends: bool


class Sentence(NamedTuple):
    skeleton: int
    words: int
    fixed: int
    strange: int
    names: list[str]
    forms: list[tuple[int, str, str]]
    filled: bool


class SentenceReader:
    """Reads texts as sentences, with the words of ``prose`` as what isn't strange. Tokens are looked up in a bounded memo."""

    def __init__(self, prose: frozenset[str]):
        self.prose = prose
        self.memo: dict[str, Token] = {}

    def _token(self, token: str) -> Token:
        core = token.strip(_TRIM)
        ends = bool(_SENTENCE_END.search(token))
        if "%(" in token or "(" in core and ")" in token:
            core = token.strip(".,;:!?…\"“”„‘’'")
        low = core.lower()
        if not core:
            form = form_of(token) if _BLANK.fullmatch(token) else None
            got = Token("form" if form else "", b"", token, form, 0, 0, ends)
        elif form := form_of(core):
            got = Token("form", b"", core, form, 0, 0, ends)
        elif _WORD.fullmatch(core):
            parts = _LETTERS.findall(low)
            kind = "name" if core[0].isupper() else "word"
            got = Token(kind, xxhash.xxh3_64_digest(low), core, None, len(parts), sum(p not in self.prose for p in parts), ends)
        elif any(c.isdigit() for c in core) or any(c in core[1:-1] for c in "./@\\=_:") or not any(c.isalpha() for c in core):
            got = Token("slot" if any(c.isalnum() for c in core) else "", b"", core, None, 0, 0, ends)
        else:
            parts = _LETTERS.findall(low)
            got = Token("word", xxhash.xxh3_64_digest(low), core, None, len(parts), sum(p not in self.prose for p in parts), ends)
        if len(self.memo) > MEMO:
            self.memo.clear()
        self.memo[token] = got
        return got

    def line(self, line: str) -> Iterator[Sentence]:
        if BLANK_JOIN not in line and any(c in line for c in "{[<"):
            line = _BRACKETS.sub(lambda m: BLANK_JOIN.join(m[0].split()), line)
        memo, make = self.memo, self._token
        part: list[Token] = []
        for token in line.split():
            got = memo.get(token) or make(token)
            part.append(got)
            if got.ends and (got.kind != "name" or len(got.core) > 1):  # an initial ends no sentence
                yield self._sentence(part)
                part = []
        if part:
            yield self._sentence(part)

    @staticmethod
    def _sentence(part: list[Token]) -> Sentence:
        keys: list[bytes] = []
        names: list[str] = []
        forms: list[tuple[int, str, str]] = []
        fixed = strange = slots = 0
        in_slot = in_name = filled = False
        for i, t in enumerate(part):
            kind = t.kind
            if not kind:
                continue
            if kind == "word" or kind == "name" and not i and not t.strange:
                keys.append(t.digest)
                fixed += t.words
                strange += t.strange
                in_slot = in_name = False
                continue
            if not in_slot:
                keys.append(b"\0")
                slots += 1
            in_slot = True
            if kind == "name":
                filled = True
                if in_name:
                    names[-1] += " " + t.core
                else:
                    names.append(t.core)
            elif kind == "form":
                forms.append((slots, t.form, t.core))
            else:
                filled = True
            in_name = kind == "name"
        return Sentence(xxhash.xxh3_64_intdigest(b"".join(keys)) - (1 << 63), len(part), fixed, strange, names, forms, filled and not forms)

    def record(self, lines: list[str]) -> tuple:
        """The columns of ``SIGNS``: words of plain sentences, strange sentences, forms, skeletons of filled sentences."""
        plain, odd, forms, filled = 0, [], [], set()
        shown: list[str] | None = None
        for line in lines:
            for s in self.line(line):
                if s.strange and s.strange + len(s.names) >= ALIGN_FROM * (s.fixed + len(s.names)):
                    odd.append({
                        "skeleton": s.skeleton, "words": s.words, "fixed": s.fixed, "strange": s.strange,
                        "names": [{"value": xxhash.xxh3_64_intdigest(v) - (1 << 63), "words": len(_LETTERS.findall(v)), "strange": sum(w not in self.prose for w in _LETTERS.findall(v.lower()))} for v in s.names],
                    })
                elif s.words >= NEUTRAL_WORDS:
                    plain += s.words
                if s.forms:
                    if shown is None:
                        shown = [m[1] for x in lines for m in _QUOTED.finditer(x) if len(m[1].split()) <= 4]
                    for pos, form, core in s.forms:
                        bare = core.replace(BLANK_JOIN, " ")
                        if not any(bare in q and len(q) > len(bare) + 2 for q in shown):
                            forms.append({"skeleton": s.skeleton, "slot": pos, "form": form, "anchored": s.fixed >= FIXED_WORDS})
                elif s.filled and s.fixed >= FIXED_WORDS:
                    filled.add(s.skeleton)
        return plain, odd, forms, list(filled)


_NAMES = pa.list_(pa.struct([("value", pa.int64()), ("words", pa.int32()), ("strange", pa.int32())]))
_ODD = pa.list_(pa.struct([("skeleton", pa.int64()), ("words", pa.int32()), ("fixed", pa.int32()), ("strange", pa.int32()), ("names", _NAMES)]))
_FORMS = pa.list_(pa.struct([("skeleton", pa.int64()), ("slot", pa.int32()), ("form", pa.string()), ("anchored", pa.bool_())]))
SIGNS = {"plain_words": pa.int32(), "odd": _ODD, "forms": _FORMS, "filled": pa.list_(pa.int64())}
OUT = (
    "src string, row_id bigint, address bigint, plain_words int,"
    " odd array<struct<skeleton bigint, words int, fixed int, strange int, names array<struct<value bigint, words int, strange int>>>>,"
    " forms array<struct<skeleton bigint, slot int, form string, anchored boolean>>, filled array<bigint>"
)


def _batch(src: str, ids, addresses, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([src] * len(rows), pa.string()), ids.cast(pa.int64()), addresses, *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(SIGNS.values()))],
        ["src", "row_id", "address", *SIGNS])


def prose_words(texts: DataFrame, text_col: str = "text", most: int = PROSE_WORDS, least: int = PROSE_LEAST) -> frozenset[str]:
    """The words of prose: of all texts, counted before they move, those that occur ``least`` times; the ``most`` frequent."""
    words = texts.select(F.explode(F.regexp_extract_all(F.lower(text_col), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    counted = words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return frozenset(r[0] for r in counted.orderBy(F.desc("n"), "word").limit(most).collect())


def _address(df: DataFrame, url_col: str | None, key: str):
    """Addresses as hashes, without scheme, query and marks; a record without one is an address of its own."""
    own = F.xxhash64(F.lit("row"), F.col(key))
    if url_col is None or url_col not in df.columns:
        return own
    bare = F.regexp_replace(F.lower(F.col(url_col)), r"^https?://(www\.)?|[?#].*$|/+$", "")
    return F.when(F.length(F.trim(bare)) > 0, F.xxhash64(bare)).otherwise(own)


def snippet_signs(hits: DataFrame, prose: frozenset[str], hit_id: str = "hit_id", snippet_col: str = "snippet", url_col: str | None = "url") -> DataFrame:
    source = hits.select(F.col(hit_id).alias("row_id"), _address(hits, url_col, hit_id).alias("address"), F.col(snippet_col).alias("text")).filter(F.length("text") > 0)
    shared = hits.sparkSession.sparkContext.broadcast(prose)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = SentenceReader(shared.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            yield _batch("hit", batch.column("row_id"), batch.column("address"), [reader.record(t.split("\n")) for t in texts])

    return source.mapInArrow(run, OUT)


PAGE_OUT = f"{OUT}, blank boolean, text_lines array<int>, markdown_lines array<int>"
LANGUAGE_OUT = "page_lang string, page_sure double, foreign array<struct<line_no int, lang string, sure double>>"
_FOREIGN = pa.list_(pa.struct([("line_no", pa.int32()), ("lang", pa.string()), ("sure", pa.float64())]))


def page_signs(
    pages: DataFrame, prose: frozenset[str], code: LanguageCode | None = None, page_id: str = "page_id", markdown_col: str = "markdown",
    text_col: str = "text", url_col: str | None = "url", keep: tuple[str, ...] = (), foreign_words: int = 8,
) -> DataFrame:
    """Signs of residue in what the block labeller keeps as the article and, from the same reading, the furniture's line
    numbers (from 1) in both fields.

    With ``code`` also the language of most of the article and its lines of ``foreign_words`` words or more in another one.
    Columns named in ``keep`` pass through.
    """
    source = pages.select(
        F.col(page_id).alias("row_id"), _address(pages, url_col, page_id).alias("address"), F.col(markdown_col).alias("markdown"), F.col(text_col).alias("text"), *keep)
    shared = pages.sparkSession.sparkContext.broadcast((prose, code))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = BlockLabeller.shipped(), Reader()
        words, known = shared.value
        sentences, detector = SentenceReader(words), Detector(known) if known else None
        for big in batches:
            for begin in range(0, big.num_rows, 512):
                batch = big.slice(begin, 512)
                texts = batch.column("text").to_pylist()
                marked, plain = label_batch(model, reader, batch.column("markdown").to_pylist(), texts)
                signs = _batch("page", batch.column("row_id"), batch.column("address"), [sentences.record(_article(t or "", rows)) for t, rows in zip(texts, plain)])
                blank = pa.array([not t or t.isspace() for t in texts], pa.bool_())
                columns = [*signs.columns, blank, *(pa.array([[n + 1 for n, p in rows if p > 0.5] for rows in part], pa.list_(pa.int32())) for part in (plain, marked))]
                names = [*signs.schema.names, "blank", "text_lines", "markdown_lines"]
                if detector:
                    columns += _languages(texts, plain, detector, foreign_words)
                    names += ["page_lang", "page_sure", "foreign"]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c) for c in keep)], [*names, *keep])

    kept = "".join(f", `{c}` {t}" for c, t in pages.select(*keep).dtypes) if keep else ""
    return source.mapInArrow(run, PAGE_OUT + (f", {LANGUAGE_OUT}" if code else "") + kept)


def _article(text: str, rows: list[tuple[int, float]]) -> list[str]:
    lines = text.split("\n")
    return [lines[n] for n, p in rows if p <= 0.5]


def _languages(texts: list[str | None], plain: list, detector: Detector, foreign_words: int) -> list[pa.Array]:
    """Languages of a batch of pages: all their article lines are decided at once."""
    numbers, lines, pages = [], [], []
    for k, (text, rows) in enumerate(zip(texts, plain)):
        split = (text or "").split("\n")
        for n, p in rows:
            if p <= 0.5:
                numbers.append(n)
                lines.append(split[n])
                pages.append(k)
    weight: list[dict[str, float]] = [{} for _ in texts]
    found = detector.texts(lines)
    for k, (lang, sure, n) in zip(pages, found):
        if lang:
            weight[k][lang] = weight[k].get(lang, 0.0) + n * max(sure, 0.01)
    own = [max(sorted(w), key=w.get) if w else None for w in weight]
    bare = [k for k, lang in enumerate(own) if lang is None and texts[k]]  # no article was found: the whole text decides
    for k, (lang, sure, _) in zip(bare, detector.texts([texts[k] for k in bare])):
        if lang and sure >= SURE:
            own[k], weight[k] = lang, {lang: 1.0}
    foreign: list[list[dict]] = [[] for _ in texts]
    for k, number, line, (lang, sure, _) in zip(pages, numbers, lines, found):
        if lang and lang != own[k] and sure >= SURE and len(line.split()) >= foreign_words:
            foreign[k].append({"line_no": number + 1, "lang": lang, "sure": sure})
    share = [w[lang] / sum(w.values()) if lang else 0.0 for w, lang in zip(weight, own)]
    return [pa.array(own, pa.string()), pa.array(share, pa.float64()), pa.array(foreign, _FOREIGN)]


def unfilled(signs: DataFrame) -> DataFrame:
    """(src, row_id) of records that hold a form of a variable, default or blank, as induced from all records.

    Only skeletons that some form stands in are looked up among the filled ones, which are distinct before they move."""
    forms = signs.filter(F.size("forms") > 0).select("src", "row_id", F.inline("forms"))
    places = forms.filter("anchored").select("src", "skeleton", "slot", "form").distinct()
    filled = signs.select("src", F.explode("filled").alias("skeleton")).distinct().withColumn("twin", F.lit(1))
    aligned = places.join(filled, ["src", "skeleton"], "left")
    share = F.count("twin") / F.count("*")
    induced = aligned.groupBy("src", "form").agg(F.count("twin").alias("aligned"), share.alias("share")).filter((F.col("aligned") >= ALIGNED) & (F.col("share") >= ALIGNED_SHARE))
    return forms.join(induced.select("src", "form"), ["src", "form"], "left_semi").select("src", "row_id").distinct()


def notices(signs: DataFrame) -> DataFrame:
    """(src, row_id, notice_words, text_words) of records with strange sentences, after these are aligned with each other.

    What moves are hashes of strange sentences and of the names in them, counted before they move."""
    key = ["src", "row_id", "n"]
    odd = signs.filter(F.size("odd") > 0).select("src", "row_id", "address", F.posexplode("odd").alias("n", "s")).select(*key, "address", "s.*")
    named = odd.select(*key, "address", "skeleton", F.posexplode("names").alias("slot", "v")).select(*key, "address", "skeleton", "slot", "v.*")
    value_at = named.groupBy("src", "skeleton", "slot", "value", "address").agg(F.lit(1).alias("one")).groupBy("src", "skeleton", "slot", "value").agg(F.count("*").alias("at"))
    slot = value_at.groupBy("src", "skeleton", "slot").agg(F.count("*").alias("values"), F.sum("at").alias("at"))
    varied = slot.filter((F.col("values") >= VARIES) & (F.col("values") > VARIES_SHARE * F.col("at"))).select("src", "skeleton").distinct().withColumn("varied", F.lit(True))
    recurring = slot.filter(F.col("at") >= 2).select("src", "skeleton").distinct().join(varied, ["src", "skeleton"], "left_anti")
    repeated = value_at.join(recurring, ["src", "skeleton"], "left_semi").groupBy("src", "value").agg(F.sum("at").alias("at")).filter(F.col("at") >= RECURS).select("src", "value", F.lit(True).alias("repeated"))
    of_names = named.join(repeated, ["src", "value"], "left").groupBy(*key).agg(
        F.count_if(F.col("repeated").isNull()).alias("unknown"),
        F.coalesce(F.sum(F.when(F.col("repeated"), F.col("words"))), F.lit(0)).alias("name_words"),
        F.coalesce(F.sum(F.when(F.col("repeated"), F.col("strange"))), F.lit(0)).alias("name_strange"))
    read = odd.drop("names", "address").join(varied, ["src", "skeleton"], "left").join(of_names, key, "left").fillna(0, ["unknown", "name_words", "name_strange"])
    fixed, strange = F.col("fixed") + F.col("name_words"), F.col("strange") + F.col("name_strange")
    report = F.col("varied").isNotNull() | (F.col("unknown") >= 2)
    notice = ~report & (strange >= STRANGE * fixed) & (strange > 0)
    text = report | (~notice & (F.col("words") >= NEUTRAL_WORDS))
    total = lambda when: F.coalesce(F.sum(F.when(when, F.col("words"))), F.lit(0))
    return read.groupBy("src", "row_id").agg(total(notice).alias("notice_words"), total(text).alias("text_words"))


def find_residue(signs: DataFrame) -> DataFrame:
    """(src, row_id) of the cases.

    ``signs`` is read several times; pass it through ``cut_lineage`` so that the texts are read once.
    """
    keep = ["src", "row_id", "plain_words", F.col("blank") if "blank" in signs.columns else F.lit(None).cast("boolean").alias("blank")]
    weighed = signs.select(*keep).join(notices(signs), ["src", "row_id"], "left").fillna(0, ["notice_words", "text_words"])
    notice, text = F.col("notice_words"), F.col("text_words") + F.col("plain_words")
    page = ~F.coalesce("blank", F.lit(False)) & ((text <= PAGE_WORDS) | (text <= PAGE_SHARE * notice))
    cases = weighed.filter(F.when(F.col("src") == "page", page).otherwise((notice > 0) & (text <= notice)))
    return cases.select("src", "row_id").unionByName(unfilled(signs)).distinct()
