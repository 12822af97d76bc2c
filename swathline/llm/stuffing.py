"""Pages stitched from keywords, tags, links, goods or one selling phrase instead of sentences.

List density: a text is cut into segments (lines, sentences); code, logs and tables are set aside as content.
A segment is list-like if it is a run of items rather than a sentence: goods with prices, tags, links with
hardly a word, many short items between separators, or words without the function words that hold sentences
together. Segments that go on about one phrase, which makes up much of them, are a selling phrase.

Phrase replication: the phrases (shingles of one and two words; longer ones are chains of these) of all list-like
segments of the corpus are exploded and their distinct hosts counted, combined before the shuffle. A page's
list-like words count as stitched if they are links, tags, goods or a selling phrase, or if the page repeats them
itself. Of the others those count that a phrase of two words covers which list-like segments of two hosts hold; list
density decides what else a phrase may cover. On a page that is dense with stitched words (``DENSE``) a single
replicated word is enough. In segments that read as sentences a phrase covers its words only if the page says it
again and again, as replicated sentences do not. A page is flagged if more than half of its words are stitched.

Defined results: NULL, empty and blank texts are never flagged; nor are texts with fewer than ``MIN_WORDS``
stitched words and fewer than ``MIN_LINKS`` links among them; a host of NULL is a host of its own; very long
texts are read whole; repeated rows are judged one by one; ties do not arise.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swathline.session import cut, spread

MIN_WORDS = 8
MIN_LINKS = 3
SHARE = 0.5
MIN_HOSTS = 2
#: From this share of firmly stitched words on, single replicated words of lists count on a page.
DENSE = 0.2
#: Below this share of function words a segment is no sentence.
GLUE = 0.2
#: A selling phrase is said this often in a row and makes up this share of the words there.
TIMES = 3
PHRASE_SHARE = 0.3

# Function words of the corpus' languages (English, German, French, Spanish, Russian).
FUNCTION_WORDS = frozenset(
    """
a about after again all also an and any are as at be because been before being but by can can't cannot could did didn't do
does doesn't doing don't down each either else enough even ever every few for from get gets had has hasn't have haven't he
her here his how however i i'd i'm i've if in into is isn't it it's its itself just let like many may me might mind mine
more most much my need never no nor not nothing now of off often on once one only or other our out over own please rather
same see shall she should shouldn't since so some somebody someone something sometimes still such than thanks that that's
the their them then there these they they've thing this those though through to too try turn twice two under until up us
used very was wasn't we we're well were what when whenever where whether which while who whom whose why will with without
won't would wouldn't yes yet you you'll your
aber als alles an auch auf aus bei das dass daß dein dem den der des die dich dir du durch ein eine einem einen einer eines
er erst es für gibt habe haben hat hatte hilft ich ihr im in ist jede jeder kann kannst kein keine könnte leider man mehr
mein meine mich mir mit muss nach nicht noch nur oder ohne schon sehr seit sich sie sind so soll sollte sonst über und
unter von vor vorher wann war warum was weil wenn wer werden wie wir wird wo wurde würde zu zum zur damit dann gleichzeitig
ai après as au aussi aux avant avec avez avoir avons beaucoup bien c’est c’était ce ces cet cette chez comment d d’abord
dans de depuis des dont du elle en est et étaient était être faut il ils je l la le les leur lui ma mais me même merci mes
moins mon n n’est n’y ne nous on ont ou où par pas plus pour pourquoi puis qu qu’il quand que qui quoi s’il sa sans se ses
si son sont sous sur ta te tes ton tous tout trop tu un une vaut vous y peut
al alguien antes así como cómo con conviene cuando cuándo de del desde después dónde donde el él ella en entre eran es esa
ese eso esta está están este esto estoy fue gracias ha hace hacia han hasta hay he la las le les lo los me mi mis muy más
menos nada ni no nos o os otra otro para pero por porque primero pues que qué quien quién se sea ser si sin sobre son su
sus también te tiene toda todas todo todos tu un una unas uno unos y ya yo
а без был была были было быть в вам вас ведь во вот все всегда всего всех вы где да даже для до его ее её ей если есть еще
ещё же за зачем и из или им их к как какой когда кто куда ли лучше мне можно мой мы на надо не него нет нибудь ничего но
о об от по под после потом почему при про раз с сам своего свою себе себя сейчас сначала снова со так там тебя тем теперь
то тоже только том тот тут ты у уже хоть чего чем через что чтобы чуть эти это этого этой этом этот эту я помощью пока решил
""".split()
)

_URL = r"(?:https?://|www\.)[^\s<>\"')\]]+"
_MARK = "\ue000"


class Reader:
    """Compiled patterns of one worker, and the judgement of a text."""

    def __init__(self) -> None:
        import re

        import regex

        self.code = re.compile(r"```.*?(?:```|\Z)|<pre\b.*?(?:</pre>|\Z)|<code\b.*?(?:</code>|\Z)", re.S)
        self.md = re.compile(rf"\[([^\]\n]*)\]\(\s*{_URL}\s*\)")
        self.anchor = re.compile(r"<a\s[^<>]*>(.*?)</a>", re.S | re.I)
        self.url = re.compile(_URL)
        self.tag = re.compile(r"</?[a-zA-Z][^<>]*>")
        self.line = re.compile(r"[\r\n\x0b\x0c\x85\u2028\u2029]+")
        self.content = re.compile(r"^ {4}|^\t|^\s*\||^\s*\d\d:\d\d:\d\d|^\s*\$ |^\s*[\w.\-]+\s*==\s*\S|^\s*[\w.\-]+ = |^\s*(?:SELECT|FROM|WHERE|GROUP BY|HAVING|ORDER BY)\b|[{};]\s*$")
        self.sentence = re.compile(r"(?<=[.!?…])[)\"'»”]*(?:\s+|$)|(?<=[。！？])")
        self.word = regex.compile(r"[\p{L}\p{M}][\p{L}\p{M}'’\-]*")
        self.price = re.compile(r"(?<![\w.])\d+[.,]\d\d(?![\w.]*\d)")
        self.code_number = regex.compile(r"\b\p{Lu}{2,}-\d+\b")
        self.digit = re.compile(r"(?<![#\w])\d")
        self.stop = re.compile(r"[.!?…。！？][)\"'»”]*\s*$")
        self.kana = regex.compile(r"\p{Hiragana}")
        self.item = re.compile(r"\s*[,;|•·*]\s*|\s+[-–—/]\s+")

    def segments(self, text: str) -> tuple[int, list[str]]:
        """Words of code, logs and tables, and the other segments (links replaced by a mark)."""
        aside = 0
        out = []
        for m in self.code.finditer(text):
            aside += len(m.group().split())
        t = self.code.sub("\n", text)
        t = self.anchor.sub(lambda m: f" {m.group(1)} {_MARK} ", t)
        t = self.md.sub(lambda m: f" {m.group(1)} {_MARK} ", t)
        t = self.tag.sub("\n", self.url.sub(f" {_MARK} ", t))
        for line in self.line.split(t):
            if not line.strip():
                continue
            if self.content.search(line) and _MARK not in line:
                aside += len(line.split())
                continue
            out += [s for s in (p.strip() for p in self.sentence.split(line) if p) if s]
        return aside, out

    def kind(self, s: str, tokens: list[str], words: list[str], links: int) -> str:
        """g goods, t tags, l links, k keywords, or s for anything that counts as content."""
        glue = sum(w in FUNCTION_WORDS for w in words)
        if not links and words and glue >= GLUE * len(words) and "#" not in s and "-" not in s:
            # A plain sentence has too few separators for a list of items.
            if sum(map(s.count, ",;|•·*/–—")) < 4:
                return "s"
        if self.price.search(s) and self.code_number.search(s):
            return "g"
        tags = sum(t.startswith("#") and len(t) > 1 for t in tokens) if "#" in s else 0
        if tags and tags * 2 >= len(tokens):
            return "t"
        kana = len(self.kana.findall(s))
        told = bool(self.stop.search(s)) and not s.endswith("!!!") and (len(words) >= 3 and glue > 0 or kana >= 3)
        if links and (told or kana >= 8):
            return "s"
        if links and len(words) <= 4 * links:
            return "l"
        items = [i for i in self.item.split(s) if i]
        if len(items) >= 5 and len(tokens) <= 3.5 * len(items) and not self.digit.search(s):
            return "k"
        if kana >= 3:
            return "s"
        if words and glue >= GLUE * len(words):
            return "s"
        if tags:
            return "t"
        if links:
            return "l"
        return "s" if self.digit.search(s) or not words else "k"

    def selling(self, words: list[list[str]], kinds: list[str]) -> None:
        """Turn rows of segments about one phrase to kind x."""
        single = Counter(w for ws in words for w in ws)
        # A phrase is said no more often than its rarest word.
        often = {w for w, c in single.items() if c >= TIMES and w not in FUNCTION_WORDS}
        if not often:
            return
        # The places of each phrase; one word longer in every round, as long as it is said often enough. A phrase that
        # only segments hold which are turned already turns no more, nor do longer ones.
        at: dict[str | tuple, list[tuple[int, int]]] = {}
        for n, ws in enumerate(words):
            for i, w in enumerate(ws):
                if w in often:
                    at.setdefault(w, []).append((n, i))
        k, letters = 1, {w: len(w) for w in at}
        while at:
            for g, places in at.items():
                if letters[g] >= 3:
                    self.turn(Counter(n for n, _ in places), k, words, kinds)
            longer: dict[str | tuple, list[tuple[int, int]]] = {}
            sizes: dict[str | tuple, int] = {}
            for at_g, (g, places) in enumerate(at.items()):
                if all(kinds[n] not in "sk" for n, _ in places):
                    continue
                for n, i in places:
                    if i + k < len(words[n]) and (w := words[n][i + k]) in often:
                        longer.setdefault((at_g, w), []).append((n, i))
                        sizes[at_g, w] = letters[g] + len(w)
            at = {g: places for g, places in longer.items() if len(places) >= TIMES}
            letters, k = sizes, k + 1

    @staticmethod
    def turn(hits: Counter, size: int, words: list[list[str]], kinds: list[str]) -> None:
        """Turn the rows of segments that a phrase of ``size`` words, said so often in each, makes up enough of."""
        run: list[int] = []
        for i in [*sorted(hits), -1]:
            if run and i != run[-1] + 1 or i >= 0 and kinds[i] not in "skx":
                said = sum(hits[j] for j in run)
                if said >= TIMES and said * size >= PHRASE_SHARE * sum(len(words[j]) for j in run):
                    for j in run:
                        kinds[j] = "x"
                run = []
            if i >= 0 and kinds[i] in "skx":
                run.append(i)

    def read(self, text: str) -> tuple[int, int, int, dict[str, list[int]], list[str]]:
        """Words in all, firmly stitched words, links among them, open phrases with the places of their words, phrases for the corpus."""
        aside, segs = self.segments(text)
        tokens = [s.split() for s in segs]
        words = [[w.lower() for w in self.word.findall(s.replace(_MARK, " "))] for s in segs]
        links = [s.count(_MARK) for s in segs]
        kinds = [self.kind(s, t, w, n) for s, t, w, n in zip(segs, tokens, words, links, strict=True)]
        self.selling(words, kinds)
        total = aside + sum(map(len, tokens))
        firm = n_links = 0
        own: Counter = Counter()
        told: Counter = Counter()
        phrases: set[str] = set()
        before: list[str] = []
        for t, w, n, k in zip(tokens, words, links, kinds, strict=True):
            if k == "s":
                told.update(w)
                before = []
                continue
            phrases.update(w)
            # A list may have an item a line: its phrases go on from one list-like segment to the next.
            phrases.update(f"{a} {b}" for a, b in zip(before + w, (before + w)[1:]))
            before = w[-1:]
            if k == "k":
                own.update(w)
                firm += len(t) - len(w)
            else:
                firm += len(t)
                n_links += n
        firm = max(firm + sum(c for c in own.values() if c > 1), 0)
        once = sum(c == 1 for c in own.values())
        # A phrase is said no more often than its words.
        if not self.enough(total, firm + once + sum(c for w, c in told.items() if c + own[w] > 1), n_links):
            return total, firm, n_links, {}, sorted(phrases)
        places = self.places(words, kinds, own, firm >= DENSE * total)
        if not self.enough(total, firm + len({i for at in places.values() for i in at}), n_links):
            places = {}
        return total, firm, n_links, places, sorted(phrases)

    @staticmethod
    def enough(total: int, stitched: int, links: int) -> bool:
        return stitched > SHARE * total and (stitched >= MIN_WORDS or links >= MIN_LINKS)

    def places(self, words: list[list[str]], kinds: list[str], own: Counter, dense: bool) -> dict[str, list[int]]:
        """The phrases that may cover words not yet stitched, with the places of these words in the page."""
        said = Counter(g for ws, k in zip(words, kinds, strict=True) if k in "sk" for g in zip(ws, ws[1:]))
        out: dict[str, list[int]] = {}
        start, last = 0, ""
        for ws, k in zip(words, kinds, strict=True):
            if k == "k" and last and ws and (at := [start + j for j, w in ((-1, last), (0, ws[0])) if own[w] == 1]):
                out.setdefault(f"{last} {ws[0]}", []).extend(at)
            last = ws[-1] if k == "k" and ws else ""
            if k == "k" and dense:
                for i, w in enumerate(ws):
                    if own[w] == 1:
                        out.setdefault(w, []).append(start + i)
            if k in "sk":
                for i, g in enumerate(zip(ws, ws[1:])):
                    at = [start + i + j for j in (0, 1) if own[g[j]] == 1] if k == "k" else [start + i, start + i + 1] if said[g] > 1 else []
                    if at:
                        out.setdefault(f"{g[0]} {g[1]}", []).extend(at)
            start += len(ws)
        return out


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reader = Reader()
    for pdf in batches:
        got = [reader.read(t) if isinstance(t, str) else (0, 0, 0, {}, []) for t in pdf["_text"]]
        yield pd.DataFrame({
            "doc": pdf["doc"].to_numpy(), "host": pdf["host"], "total": np.array([g[0] for g in got], np.int64),
            "firm": np.array([g[1] for g in got], np.int64), "links": np.array([g[2] for g in got], np.int64),
            "open": [list(g[3]) for g in got], "places": [list(g[3].values()) for g in got], "phrases": [g[4] for g in got],
        })


def stuffed_pages(df: DataFrame, doc: str, text: str, host: str, min_hosts: int = MIN_HOSTS) -> DataFrame:
    """Flagged pages: doc, words, stitched words, links, share."""
    rows = spread(df.select(F.col(doc).alias("doc"), F.col(text).alias("_text"), F.coalesce(F.col(host), F.lit("")).alias("host")))
    read = cut(rows.mapInPandas(_read, "doc bigint, host string, total bigint, firm bigint, links bigint, open array<string>, places array<array<int>>, phrases array<string>")
               .where("size(phrases) > 0 OR firm > 0 OR size(open) > 0").withColumn("row", F.monotonically_increasing_id()))
    held = read.select(F.explode("phrases").alias("phrase"), "host").groupBy("phrase").agg(F.count_distinct("host").alias("hosts"))
    held = held.where(F.col("hosts") >= min_hosts).select("phrase")
    opened = read.select("row", F.explode(F.arrays_zip("open", "places")).alias("p")).select("row", F.col("p.open").alias("word"), F.col("p.places").alias("at"))
    shown = opened.join(held, F.col("word") == F.col("phrase"), "left_semi").groupBy(F.col("row").alias("r")).agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("elsewhere"))
    pages = read.where((F.col("firm") > SHARE * F.col("total")) | (F.size("open") > 0))
    out = pages.join(shown, F.col("row") == F.col("r"), "left").withColumn("stitched", F.col("firm") + F.coalesce("elsewhere", F.lit(0)))
    out = out.where((F.col("stitched") > SHARE * F.col("total")) & ((F.col("stitched") >= MIN_WORDS) | (F.col("links") >= MIN_LINKS)))
    return out.select(F.col("doc").alias(doc), F.col("total").alias("words"), "stitched", "links", (F.col("stitched") / F.col("total")).alias("share"))
