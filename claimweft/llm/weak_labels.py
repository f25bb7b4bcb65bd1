"""Weak labels for the block labeller: which lines of a bounded sample of pages are furniture.

Used once, offline, to train the weights that the package ships (``python -m claimweft.llm.train_blocks``); no query runs
it. A line is furniture where its form or its spread over hosts says so: it is an image or only links, it occurs on
several hosts in words that no claim uses, it is made of such phrases or of words that no claim uses, it is linked as a teaser elsewhere on the same
host, or it is an item below a heading that mostly stands above linked teasers.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from claimweft.llm.blocks import ARTICLE, BLANK, FURNITURE, bare_line

_LINKS_ONLY = re.compile(r"\s*([-*+]|\d+[.)])?\s*(\[[^\]]*\]\([^)]*\)[\s|/·»›>–•,-]*)+")
_TEASER = re.compile(r"\[([^\]]*)\]\(/\d+\)\s*\Z")
_ITEM = re.compile(r"\s*([-*+]|\d+[.)])\s+|\s*\[")
_PARTS = re.compile(r"\s*(?:[|/·»›>–•]|\s{2,})\s*")
_SENTENCES = re.compile(r"(?<=[.!?])\s+")

_NAME = r"[^\W\d][\w.]{0,30}"
#: Slots whose syntax no prose has.
_SLOTS = re.compile(
    rf"\{{\{{\s*{_NAME}\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|\{{%[^{{}}%]*%\}}|<%[^<>%]*%>|%\({_NAME}\)[sd]|\[\[\s*{_NAME}\s*\]\]|@@{_NAME}@@"
    rf"|__[A-Z][A-Z0-9_.]*__|(?<!\w)#[A-Z][A-Z0-9_.]*#|(?<![\w%])%[A-Z][A-Z0-9_.]*%|(?<![\w{{$]){{{_NAME}}}(?!\}})"
    rf"|\[(?:INSERT|ENTER|ADD|YOUR)\b[^\[\]]*\]|\[[^\[\]]{{1,40}} (?:eintragen|einfügen|insérer|insertar|inserire|invullen)\]|(?<!\w)XXX+(?!\w)|(?<!\w)xxx+(?!\w)"
)
#: Endings of mock Latin, the usual filler; a sentence of it has no function word of any language.
_LATIN = re.compile(r"(?:us|um|is|it|am|et|or|ur|a|em|at|unt|ent|iet|amet)\Z")
_REPORT = re.compile(
    r"\b[A-Z]\. [A-ZÀ-Ý][a-zà-ÿ]{3,}|\b(?:said|told|admitted|confirmed|sagte|räumte|erklärte|dijo|explicó|admitió|reconoció|a dit|a admis|a reconnu|a expliqué|ha detto|ha ammesso|ha spiegato|zei|vertelde|gaf toe|argues|appealed)\b")


def mock_latin(words: list[str], function_words: frozenset[str]) -> bool:
    """Six words or more without a function word, most of them with Latin endings, and hardly a capital."""
    if len(words) < 6 or not function_words.isdisjoint(map(str.lower, words)):
        return False
    bare = [w.strip(",.;:!?…") for w in words]
    return sum(bool(_LATIN.search(w.lower())) for w in bare) >= 0.6 * len(words) and sum(w[:1].isupper() for w in bare) <= max(2, len(words) // 8)


def host_of(url: str | None) -> str:
    host = re.sub(r"^https?://", "", (url or "").lower()).split("/")[0]
    return re.sub(r"^(www|m|news)\.", "", host)


def letters(text: str) -> list[str]:
    return re.findall(r"[^\W\d_]+", text.lower())


class WeakLabeller:
    """Fitted on rows (url, markdown); ``claims`` and their languages give the words and the names of articles."""

    def __init__(self, pages: list[tuple[str, str]], claims: list[str], languages: list[str | None], hosts: int = 6):
        known = Counter(w for c in claims for w in set(letters(c)))
        self.words = {w for w, n in known.items() if n >= 5}
        self.names = self.names_of(claims, languages)
        spread, leads = defaultdict(set), defaultdict(set)
        seen, above = Counter(), Counter()
        self.teasers = defaultdict(set)
        for url, markdown in pages:
            host = host_of(url)
            for line in set(markdown.split("\n")):
                if not line.strip():
                    continue
                key = self.key(line, host)
                for k in {key, *_SENTENCES.split(key), *(p for p in _PARTS.split(self.key(line, host, False)) if len(p.split()) <= 5)}:
                    spread[k].add(host)
                if ":" in key:
                    leads[key.split(":")[0]].add(host)
                if m := _TEASER.search(line):
                    self.teasers[host].add(m[1].strip())
            keys = [(self.key(x, host), bool(_TEASER.search(x))) for x in markdown.split("\n") if x.strip()]
            for (key, _), (_, teaser) in zip(keys, keys[1:]):
                seen[key] += 1
                above[key] += teaser
        self.phrases = {k for k, h in spread.items() if k and len(h) >= hosts and (len(letters(k)) <= 1 or "SITE" in k or self.foreign(k) >= 0.25)}
        self.phrases |= {k for k, h in spread.items() if len(h) >= 5 * hosts and len(letters(k)) <= 6}
        self.headings = {k for k in self.phrases if above[k] >= 0.15 * seen[k] and above[k] >= 5 and len(letters(k)) <= 8}
        self.short = {k for k in self.phrases if len(k) < 40}
        self.leads = {k for k, h in leads.items() if len(h) >= hosts and (self.foreign(k) >= 0.5 or len(h) >= 5 * hosts and len(k.split()) > 1)}
        self.composed: dict[str, bool] = {}
    @staticmethod
    def names_of(claims: list[str], languages: list[str | None]) -> set[str]:
        """Words that claims write with a capital within a sentence, and hardly ever without. German, which writes all nouns so,
        doesn't count; the names of its claims are those of the others."""
        large, small = Counter(), Counter()
        for claim, lang in zip(claims, languages):
            if lang in (None, "de") or "\n" in claim:  # claims in two lines mix languages
                continue
            for i, w in enumerate(re.findall(r"[^\W\d_]+", claim)):
                if not w[0].isupper():
                    small[w] += 1
                elif i and len(w) > 2 and not w.isupper():
                    large[w] += 1
        return {w for w, n in large.items() if n > 3 * small[w.lower()]}

    def foreign(self, key: str) -> float:
        words = letters(key)
        return sum(w not in self.words for w in words) / max(1, len(words))

    @staticmethod
    def key(line: str, host: str, squeeze: bool = True) -> str:
        text = re.sub(r"\d+", "0", bare_line(line, squeeze))
        site = host.split(".")[0]
        return re.sub(re.escape(site), "SITE", text, flags=re.I) if site else text

    def is_composed(self, key: str) -> bool:
        if key not in self.composed:
            self.composed[key] = key in self.phrases or self._parts(_PARTS.split(key)) or self._parts(_SENTENCES.split(key)) or self._covered(key)
        return self.composed[key]

    def in_own_words(self, line: str, host: str) -> bool:
        """Two words and three in ten, names left aside, are such as no claim uses. Lines with unfilled slots or mock Latin
        don't count, nor do sentences that speak of named places or people."""
        text = self.key(line, host)
        if _SLOTS.search(line) or mock_latin(text.split(), frozenset()) or _REPORT.search(text):
            return False
        written = re.findall(r"[^\W\d_]+", text)
        if any(w in self.names for w in written[1:]) or text.islower():
            return False
        german = any(w in ("und", "die", "der", "wir", "Wir", "Sie", "Ihre", "Ihr", "Unser", "auf", "mit") for w in written)
        if not german and any(w[0].isupper() and len(w) >= 6 and w.lower() not in self.words and w not in ("SITE", "JavaScript") for w in written[1:]):
            return False  # an unknown name
        strange = sum(w.lower() not in self.words and w not in self.names and w != "SITE" for w in written)
        return strange >= max(2, 0.3 * len(written))

    def _parts(self, parts: list[str]) -> bool:
        parts = [p for p in parts if p]
        return len(parts) > 1 and sum(p in self.phrases for p in parts) >= 0.6 * len(parts)

    def _covered(self, key: str) -> bool:
        words, i, n = key.split(" "), 0, 0
        while i < len(words):
            for j in range(min(len(words), i + 8), i, -1):
                if " ".join(words[i:j]) in self.short:
                    n, i = n + j - i, j
                    break
            else:
                i += 1
        return len(words) > 1 and n >= 0.8 * len(words)

    def label(self, url: str, markdown: str) -> list[int]:
        host = host_of(url)
        lines = markdown.split("\n")
        out = []
        for line in lines:
            if not line.strip():
                out.append(BLANK)
                continue
            key = self.key(line, host)
            furniture = not re.match(r"\s*# ", line) and (
                line.lstrip().startswith(("![", "+++")) or bool(_LINKS_ONLY.fullmatch(line)) or "©" in line or bare_line(line) in self.teasers[host]
                or ":" in key and key.split(":")[0] in self.leads or self.is_composed(key) or self.is_composed(self.key(line, host, False)) or self.in_own_words(line, host)
            )
            out.append(FURNITURE if furniture else ARTICLE)
        self._below_headings(host, lines, out)
        return out

    def _below_headings(self, host: str, lines: list[str], out: list[int]) -> None:
        """Items under a teaser heading, up to the next furniture or the next text that is no item."""
        at = [i for i, x in enumerate(out) if x != BLANK]
        for n, i in enumerate(at):
            if out[i] != FURNITURE or self.key(lines[i], host) not in self.headings:
                continue
            last = n
            for m in range(n + 1, len(at)):
                line, text = lines[at[m]], bare_line(lines[at[m]])
                if line.lstrip().startswith("#") or len(_SENTENCES.split(text)) > 1 or out[at[m]] == FURNITURE and not _ITEM.match(line) and text not in self.teasers[host]:
                    break
                if _ITEM.match(line) or out[at[m]] == FURNITURE or not re.search(r"[.!?…][”»“\"’)]*$", text):
                    last = m
                elif m - last > 1:
                    break
            for m in range(n + 1, last + 1):
                out[at[m]] = FURNITURE
