"""Keyword-stuffed and link-list pages, as outliers in spam-directed directions.

1. Features of a text: share of function words, entropy of its words, repetition of its commonest word or pair, density
   of links, tags and codes, density of separators. The language is told from script and function words.
2. Robust location and scatter per language: quartiles (mergeable summaries), then means and products of the documents that are
   near, re-weighted twice. A language's scatter is drawn towards that of all documents as if ``prior`` of those were its
   own, so that a language with few documents is judged like any other. Documents whose Mahalanobis distance is large, in
   directions that lead to spam, are outliers; those far out are the core of the spam.
3. The core's vocabulary: words whose share of the core's words is a multiple of their share of ordinary documents' words.
4. The exact check of every outlier: parts of the text (between separators) that consist by half or more of links, tags and
   words of that vocabulary hold more than half of its words, or one name (one word or more, or in Chinese two
   characters or more) is there eight times or more and makes up a fifth or more of them.

All statistics are over the documents of ``shortest`` characters and more, which alone can be cases. One pass over the texts makes
the features, and counts the words per batch; both are written as a table, whose narrow columns the statistics read. Only outliers are taken
apart again, to subtract their words from the ordinary ones and for the check. The vocabulary stays a table and is joined to the outliers' words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.lineage import written

#: Function words by language; of Chinese, characters.
FUNCTION_WORDS = {
    "en": "the a an of to in on at by for with from and or but not no is are was were be been has have had do does did will would can could may must this that these those it its he she they we you i his her their our my your as if than then so who which what when where how there under inside behind near before after during beside into over every once",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber nicht kein keine ist sind war waren sein hat haben hatte wird werden wurde kann können muss ich du er sie es wir ihr sein seine mein meine unser unsere dieser diese dieses zu in im am an auf aus bei beim mit nach von vom vor zum zur über unter hinter neben zwischen während für durch als wie wenn dass wer was wo jeden jeder jede einmal",
    "fr": "le la les l un une des du au aux et ou mais ne pas est sont était a ont avait sera peut doit je tu il elle nous vous ils elles son sa ses mon ma mes notre nos leur ce cet cette ces de d à en dans sur sous par pour avec sans avant après pendant près chez entre qui que qu quoi où si comme chaque fois",
    "es": "el la los las un una unos unas y o pero no es son era fue ha han había será puede debe yo tú él ella nosotros ellos su sus mi mis nuestro nuestra este esta estos estas ese esa de del a al en con sin por para sobre bajo debajo entre antes después durante hasta desde junto cerca que quien si como cada vez se le lo",
    "ru": "и в во на не с со у о об от до из за к ко по под над при для без перед после между через возле около во что кто где как когда если или но а же бы ли это этот эта эти он она оно они мы вы я его её их наш наша мой моя был была были было есть будет раз каждый",
    "zh": "的 了 在 是 不 我 你 他 她 它 们 这 那 有 和 与 或 到 从 把 被 给 向 对 为 以 于 里 上 下 前 后 旁 个 一 每 之 吗 呢 吧 着 过 就 也 都 还 又 很 请 谁",
}
LANGUAGES = tuple(FUNCTION_WORDS)
FEATURES = ("function_share", "entropy", "repetition", "density", "separators")
#: The sign of a deviation that leads to spam.
TOWARDS = np.array([-1.0, -1.0, 1.0, 1.0, 1.0])
#: Least scale of a feature, where most documents agree.
LEAST_SCALE = np.array([0.03, 0.02, 0.02, 0.02, 0.03])

_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_ANY, _LATIN = frozenset().union(*_WORDS.values()), frozenset().union(*(_WORDS[k] for k in ("en", "de", "fr", "es")))
_BY_WORD = ("en", "de", "fr", "es")
_OF_WORD = {w: [k for k in _BY_WORD if w in _WORDS[k]] for w in _LATIN}
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_LETTER = re.compile("[A-Za-z]")
_CYRILLIC = re.compile("[\u0400-\u04ff]")
_LINK = re.compile(r"(?:https?://|www\.)[^\s()<>\[\]]+|(?<![\w.@-])(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/[^\s()<>\[\]]*)?(?![\w.])", re.I)
_ANGLE = re.compile(r"<[^<>\n]{1,60}>")
_TAG = re.compile(r"#\w[\w'’-]*")
_BREAK = r"[.!?…](?=[\s\"'»”“)]|$)|[。！？；，,;|/•·\n]|\s-\s|->|\*"
_TOKEN = re.compile(r"[^\W\d_㐀-䶿一-鿿豈-﫿]+|[㐀-䶿一-鿿豈-﫿]+|\d+(?:[.,:/]\d+)*|" + _BREAK)
_TOKEN_ASCII = re.compile(r"[a-z]+|\d+(?:[.,:/]\d+)*|[.!?](?=[\s\"')]|$)|[,;|/*\n]|\s-\s|->")
#: A necessary sign of a link: a point between characters of a host, or a scheme.
_MAYBE_LINK = re.compile(r"[a-z0-9-]\.[a-z]|://|www\.", re.I)
_SPECIAL = re.compile(r"(\x02|<[^<>\n]{1,60}>|#\w[\w'’-]*)")
_DASH = re.compile(r"\s-\s")
LINK, TAG, CODE, BREAK = "\x01link", "\x01tag", "\x01code", "\x01break"


def _script(text: str) -> str | None:
    """zh or ru if their characters are over three tenths of the letters; ``none`` without letters; else null."""
    if text.isascii():
        return None if _LETTER.search(text) else "none"
    letters = sum(map(str.isalpha, text))
    if not letters:
        return "none"
    for lang, characters in (("zh", _HAN), ("ru", _CYRILLIC)):
        if len(characters.findall(text)) > 0.3 * letters:
            return lang
    return None


def language(text: str, declared: str | None, counts: dict[str, int]) -> str:
    """By script, else by the most function words (from the text's words), else as declared; ``other`` if none of these tells."""
    script = _script(text)
    if script:
        return "other" if script == "none" else script
    hits = dict.fromkeys(_BY_WORD, 0)
    for w in counts.keys() & _LATIN:
        for k in _OF_WORD[w]:
            hits[k] += counts[w]
    code = (declared or "").strip().lower()[:2]
    best = max(hits, key=lambda k: (hits[k], k == code))
    if hits[best] >= 2 and hits[best] > hits.get(code, 0):
        return best
    return code if code in LANGUAGES else best if hits[best] else "other"


def words_of(text: str) -> list[str]:
    """The words in order: links, tags and codes (numbers, prices, sizes) as such, the rest in lower case, and a mark for what
    parts them. A run of Han characters between other characters is one word here; ``weight`` says how many it counts."""
    if _MAYBE_LINK.search(text):
        text = _LINK.sub("\x02", text)
    token = _TOKEN_ASCII if text.isascii() else _TOKEN
    if "\x02" not in text and "<" not in text and "#" not in text:
        return [w if w[0].isalpha() else CODE if w[0].isdigit() else BREAK for w in token.findall(text.lower())]
    out = []
    for part in _SPECIAL.split(text):
        if part == "\x02":
            out.append(LINK)
        elif _ANGLE.fullmatch(part) or _TAG.fullmatch(part):
            out.append(TAG)
        else:
            out += [w if w[0].isalpha() else CODE if w[0].isdigit() else BREAK for w in token.findall(part.lower())]
    return out


def weight(word: str) -> float:
    if word[0] < "\u3400":
        return 0.0 if word == BREAK else 1.0
    return max(1.0, len(word) / 2) if _HAN.match(word) else 1.0


def _separators(text: str) -> int:
    text = text.strip()
    n = sum(map(text.count, ",;|/\n*"))
    if not text.isascii():
        n += text.count("•") + text.count("·")
    if "-" in text:
        n += len(_DASH.findall(text)) + text.count("->")
    return n


def features(text: str, declared: str | None) -> tuple[str, list[float], list[str]]:
    """Language, features and words."""
    words = words_of(text)
    han = not text.isascii() and _HAN.search(text)
    n = max(1.0, sum(map(weight, words)) if han else float(len(words) - words.count(BREAK)))
    units = [w for w in words if w not in (BREAK, CODE)]
    if han:
        units = [c for w in units for c in (_pairs(w) if w[0] >= "\u3400" and len(w) > 4 and _HAN.match(w) else (w,))]
    counts = Counter(units)
    lang = language(text, declared, counts)
    if lang == "zh":
        chars = Counter(text)
        function = sum(chars[c] for c in chars.keys() & _WORDS["zh"]) / 2
    else:
        function = sum(counts[w] for w in counts.keys() & _WORDS.get(lang, _LATIN))
    m = len(units)
    entropy, top = 1.0, 0
    if m > 1:
        repeated = [(w, c) for w, c in counts.items() if c > 1] if len(counts) < m else []
        entropy = (math.log(m) - sum(c * math.log(c) for _, c in repeated) / m) / math.log(m)
        if repeated:
            known = _WORDS.get(lang, frozenset())
            again = dict(repeated)  # a pair that is there twice consists of such words
            pairs = Counter([p for p in zip(units, units[1:], strict=False) if p[0] in again and p[1] in again])
            top = max(max((c - 1 for w, c in repeated if w not in known), default=0), 2 * (max(pairs.values(), default=1) - 1))
    dense = (counts[LINK] + counts[TAG]) / n
    return lang, [function / n, entropy, top / max(1, m), dense, _separators(text) / n], words


def _pairs(run: str) -> list[str]:
    return [run[i : i + 2] for i in range(0, len(run) - 1, 2)]


@dataclass(frozen=True)
class Settings:
    """``shortest``: characters of a text that can be a case; ``outlier``, ``core``: squared distances from which a text is an
    outlier, and of the core; ``ordinary``: up to which its words count as ordinary ones; ``odds``: least ratio of a spam word's shares;
    ``mostly``, ``times``, ``part``: of the exact check; ``prior``, ``prior_centre``: documents of all languages that
    count in the scatter and in the centre of each; ``near``: squared distance of those that shape the next fit."""

    shortest: int = 60
    outlier: float = 6.63
    ordinary: float = 11.07
    core: float = 60.0
    odds: float = 3.0
    mostly: float = 0.5
    times: int = 8
    part: float = 0.2
    prior: float = 50.0
    prior_centre: float = 2.0
    near: float = 12.83


FEATURED = "part string, id long, row_key long, lang string, x array<double>, text string, word string, n long"
OUTLIER = ("id", "row_key", "lang", "d2", "spamward", "words")
#: Distinct words that a task counts before it hands the counts on.
COUNTED = 200_000


def featured(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", shortest: int = 60) -> DataFrame:
    """Of the texts of at least ``shortest`` characters: (id, row_key, lang, x, text) as part ``page``, and counts (lang, word, n) as part ``word``.

    ``id`` is the row's own, whatever its key."""
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")).where(F.length("t") >= shortest)
    schema = pa.schema([("part", pa.string()), ("id", pa.int64()), ("row_key", pa.int64()), ("lang", pa.string()), ("x", pa.list_(pa.float64())), ("text", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def batch(rows: int, **given) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(rows, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def counted() -> pa.RecordBatch:
            langs, words, counts = [g for g, c in seen.items() for _ in c], [w for c in seen.values() for w in c], [n for c in seen.values() for n in c.values()]
            seen.clear()
            return batch(len(words), part=["word"] * len(words), lang=langs, word=words, n=counts)

        for b in batches:
            for at in range(0, b.num_rows, 512):
                some = b.slice(at, 512)
                texts = some.column("t").to_pylist()
                made = [features(t, g) for t, g in zip(texts, some.column("l").to_pylist(), strict=True)]
                for g, _, words in made:
                    seen.setdefault(g, Counter()).update(words)
                yield batch(len(made), part=["page"] * len(made), row_key=some.column("k"), lang=[m[0] for m in made], x=[m[1] for m in made], text=some.column("t"))
                if sum(map(len, seen.values())) >= COUNTED:
                    yield counted()
        yield counted()

    return rows.mapInArrow(run, FEATURED).withColumn("id", F.monotonically_increasing_id())


@dataclass
class Fit:
    """Location, scale (per feature) and inverse scatter of one language's ordinary texts."""

    centre: np.ndarray
    scale: np.ndarray
    inverse: np.ndarray


def _moments(df: DataFrame) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    d = len(FEATURES)
    x = [F.col("x")[i] for i in range(d)]
    sums = [F.count("*").alias("n"), *[F.sum(x[i]).alias(f"s{i}") for i in range(d)], *[F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]]
    out = {}
    for r in df.groupBy("lang").agg(*sums).collect():  # a row per language
        s = np.array([r[f"s{i}"] for i in range(d)])
        p = np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        out[r.lang] = (r.n, s, p)
    return out


def _scatter(n: float, s: np.ndarray, p: np.ndarray) -> Fit:
    mean = s / n
    cov = p / n - np.outer(mean, mean)
    floor = np.diag((LEAST_SCALE / 2) ** 2)
    return Fit(mean, np.sqrt(np.diag(cov + floor)), np.linalg.inv(cov + floor))


def judged(df: DataFrame, fits: dict[str, Fit]) -> DataFrame:
    """With d2 and spamward under the fits; texts of no language told (``other``) have the pooled one (``*``)."""
    d = len(FEATURES)
    rows = []
    for g in (*LANGUAGES, "other"):
        f = fits.get(g, fits["*"])
        rows.append((g, [float(v) for v in f.centre], [float(v) for v in TOWARDS / f.scale], [float(v) for v in f.inverse.ravel()]))
    table = df.sparkSession.createDataFrame(rows, "f_lang string, f_centre array<double>, f_ward array<double>, f_inverse array<double>")
    off = F.zip_with("x", "f_centre", lambda x, c: x - c)
    out = df.join(F.broadcast(table), F.col("lang") == F.col("f_lang")).withColumn("f_off", off)  # a row per language
    d2 = ward = F.lit(0.0)
    for i in range(d):
        z = F.greatest(F.lit(-5.0), F.least(F.lit(20.0), F.col("f_off")[i] * F.col("f_ward")[i]))
        ward = ward + z
        for j in range(d):
            d2 = d2 + F.col("f_off")[i] * F.col("f_off")[j] * F.col("f_inverse")[i * d + j]
    return out.withColumns({"d2": d2, "spamward": ward}).select(*df.columns, "d2", "spamward")


def _drawn(own: Fit, n: float, pooled: Fit, settings: Settings) -> Fit:
    """A language's fit with ``prior`` documents of the pooled scatter, and ``prior_centre`` of the pooled centre."""
    a, c = n / (n + settings.prior), n / (n + settings.prior_centre)
    scatter = a * np.linalg.inv(own.inverse) + (1 - a) * np.linalg.inv(pooled.inverse)
    return Fit(c * own.centre + (1 - c) * pooled.centre, np.sqrt(np.diag(scatter)), np.linalg.inv(scatter))


def robust_fits(df: DataFrame, settings: Settings) -> dict[str, Fit]:
    """Fits per language and, as ``*``, of all texts: quartiles, then twice the moments of the texts that are near."""
    d = len(FEATURES)
    ask = [F.percentile_approx(F.col("x")[i], [0.25, 0.5, 0.75], 2000).alias(f"q{i}") for i in range(d)]
    by = {r.lang or "*": r for r in df.rollup("lang").agg(F.count("*").alias("n"), *ask).collect()}  # a row per language, and one of all
    if not by.get("*") or not by["*"].n:
        return {}

    def first(r) -> Fit:
        q = np.array([r[f"q{i}"] for i in range(d)], dtype=float)
        scale = np.maximum((q[:, 2] - q[:, 0]) / 1.349, LEAST_SCALE)
        return Fit(q[:, 1], scale, np.diag(1 / scale**2))

    own = {g: first(r) for g, r in by.items() if g != "other"}
    fits = {g: f if g == "*" else _drawn(f, by[g].n, own["*"], settings) for g, f in own.items()}
    for _ in range(2):
        near = judged(df, fits).where(F.col("d2") <= settings.near)
        moments = _moments(near)
        total = None
        for n, s, p in moments.values():
            total = (n, s, p) if total is None else (total[0] + n, total[1] + s, total[2] + p)
        if total is None:
            break
        pooled = _scatter(*total)
        fits |= {"*": pooled} | {g: _drawn(_scatter(n, s, p), n, pooled, settings) for g, (n, s, p) in moments.items() if g != "other"}
    return fits


def vocabulary(core: DataFrame, apart: DataFrame, everything: DataFrame, settings: Settings) -> DataFrame:
    """(lang, word) of the spam words of each language, from counts (lang, word, n): of the core, of all that is no ordinary text, and of
    all texts. Function words are none; a word is there twice or more in the core."""
    kinds = [(everything, 0, 1), (apart, 0, -1), (core, 1, 0)]
    union = None
    for df, c, o in kinds:
        rows = df.select("lang", "word", (F.col("n") * c).alias("c"), (F.col("n") * o).alias("o"))
        union = rows if union is None else union.unionByName(rows)
    counts = union.where(~F.col("word").startswith("\x01")).groupBy("lang", "word").agg(F.sum("c").alias("c"), F.sum("o").alias("o"))
    totals = counts.groupBy("lang").agg(F.sum("c").alias("cs"), F.sum("o").alias("os"))
    odd = counts.where(F.col("c") >= 2).join(F.broadcast(totals), "lang")  # a row per language
    share, usual = F.col("c") / F.greatest(F.col("cs"), F.lit(1)), (F.col("o") + 0.5) / (F.col("os") + 1)
    kept = odd.where((share >= settings.odds * usual) & ~F.col("word").isin(sorted(_ANY))).select("lang", "word")
    # Texts of no language told have the words of every one.
    return kept.withColumn("lang", F.explode(F.array("lang", F.lit("other")))).distinct()


def listed_share(words: list[str], spam: frozenset[str]) -> float:
    """The share of words in parts that consist by half or more of links, tags and spam words; numbers count neither way there."""
    total = inside = 0.0
    part: list[str] = []
    for w in [*words, BREAK]:
        if w != BREAK:
            part.append(w)
            continue
        size = sum(weight(x) for x in part)
        total += size
        plain = [x for x in part if x != CODE]
        hits = sum(weight(x) for x in plain if x in (LINK, TAG) or x in spam)
        if plain and hits >= 0.5 * sum(weight(x) for x in plain):
            inside += size
        elif any(x in (LINK, TAG) for x in part):
            inside += sum(1 for x in part if x in (LINK, TAG))
        part = []
    return inside / total if total else 0.0


def stuffed(words: list[str], lang: str, times: int, share: float) -> bool:
    """Whether one name of one word or more (Han: two characters or more) is there so often and makes up so much. A name is
    lengthened for as long as some sequence of that length is there so often."""
    total = sum(map(weight, words))
    known, han = _WORDS.get(lang, frozenset()), _WORDS["zh"]
    idle = lambda w: w in known or han.issuperset(w)
    plain = [w for w in words if w[0] != "\x01"]
    k = 1
    while True:
        often = [(g, c) for g, c in Counter(zip(*(plain[i:] for i in range(k)), strict=False)).items() if c >= times]
        if any(not idle(g[0]) and not idle(g[-1]) and c * sum(map(weight, g)) >= share * total for g, c in often):
            return True
        if not often:
            break
        k += 1
    runs, k = [w for w in plain if _HAN.match(w)], 2
    while runs:
        often = [(g, c) for g, c in Counter(r[i : i + k] for r in runs for i in range(len(r) - k + 1)).items() if c >= times]
        if any(c * max(1.0, k / 2) >= share * total and not all(x in han for x in g) for g, c in often):
            return True
        if not often:
            break
        k += 1
    return False


def spam_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """(row_key, lang, d2, spamward, listed, is_stuffed) of the spam pages among the documents.

    Texts under ``shortest`` characters, empty and null ones are no pages. A null or unknown declared language is told from
    the text. Every row is judged for itself, so repeated rows are all there; ties don't occur. Other columns are ignored.
    Without documents there are no rows.
    """
    made = written(featured(docs, key, text, lang, settings.shortest))
    pages = made.where("part = 'page'")
    fits = robust_fits(pages.select("lang", "x"), settings)
    if not fits:
        return pages.select("row_key", "lang", F.lit(0.0).alias("d2"), F.lit(0.0).alias("spamward"), F.lit(0.0).alias("listed"), F.lit(False).alias("is_stuffed"))
    far = judged(pages.select("id", "row_key", "lang", "x", "text"), fits).where((F.col("d2") >= settings.outlier) & (F.col("spamward") > 0)).drop("x")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pa.array(list(map(words_of, b.column("text").to_pylist())), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in OUTLIER[:-1]], words], names=list(OUTLIER))

    outliers = written(far.mapInArrow(cut, "id long, row_key long, lang string, d2 double, spamward double, words array<string>"))
    each = outliers.select("id", "lang", "d2", F.explode("words").alias("word"))
    counts = each.groupBy("lang", "word").agg(F.count_if(F.col("d2") >= settings.core).alias("c"), F.count_if(F.col("d2") >= settings.ordinary).alias("o"))
    spam = vocabulary(counts.select("lang", "word", F.col("c").alias("n")), counts.select("lang", "word", F.col("o").alias("n")), made.where("part = 'word'").select("lang", "word", "n"), settings)
    spam = spam.withColumnsRenamed({"lang": "s_lang", "word": "s_word"})
    # A document's own spam words, by its id: no more than its words.
    own = each.join(spam, (F.col("lang") == F.col("s_lang")) & (F.col("word") == F.col("s_word"))).groupBy(F.col("id").alias("s_id")).agg(F.collect_set("word").alias("spam"))
    met = outliers.join(own, F.col("id") == F.col("s_id"), "left").select("row_key", "lang", "d2", "spamward", "words", "spam")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, words, own = (b.column(c).to_pylist() for c in ("lang", "words", "spam"))
            listed = [listed_share(w, frozenset(s or ())) for w, s in zip(words, own, strict=True)]
            full = [stuffed(w, g, settings.times, settings.part) for g, w in zip(langs, words, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("row_key", "lang", "d2", "spamward")], pa.array(listed, pa.float64()), pa.array(full, pa.bool_())], names=["row_key", "lang", "d2", "spamward", "listed", "is_stuffed"])

    checked = met.mapInArrow(check, "row_key long, lang string, d2 double, spamward double, listed double, is_stuffed boolean")
    return checked.where((F.col("listed") > settings.mostly) | F.col("is_stuffed"))
