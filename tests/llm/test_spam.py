import random
from collections import Counter

from tickloom.llm.spam import BREAK, CODE, LINK, TAG, features, language, listed_share, spam_pages, stuffed, words_of

SENTENCES = [
    "The old miller repaired the {a} wheel before the {b} came.", "A young gardener found the {a} rope under the {b} stairs.", "Our neighbour sold two {a} blankets in the {b} square.",
    "Every Thursday the {a} clerk counts the {b} boxes on the floor.", "My aunt said that she had seen a {a} key near the {b} bridge.", "In the morning the {a} choir sang for the {b} people of the town.",
]
WORDS = "green iron wooden heavy quiet copper empty broken spare torn blue narrow early distant brass little yellow former proud humble".split()


def prose(rng, n):
    return " ".join(rng.choice(SENTENCES).format(a=rng.choice(WORDS), b=rng.choice(WORDS)) for _ in range(n))


def pages(rng):
    goods, sale = ["sofa", "lantern", "mattress", "kettle"], ["buy", "cheap", "best", "discount", "online"]
    link = lambda: f"https://www.{rng.choice(goods)}{rng.randrange(99)}.example/p?id={rng.randrange(9999)}"
    for _ in range(12):
        yield ", ".join(f"{rng.choice(sale)} {rng.choice(goods)}" for _ in range(40))
        yield " ".join(link() for _ in range(30))
        yield " ".join(f"#{rng.choice(goods)}" for _ in range(30))
        yield prose(rng, 1) + "\n" + "\n".join(f"{rng.choice(goods)}: {link()}" for _ in range(20))
        yield " ".join(w + " mattress" if i % 2 else w for i, w in enumerate(prose(rng, 6).split()))


def test_pages_are_found(spark):
    rng = random.Random(5)
    rows, cases = [], set()
    for i in range(600):
        rows.append((i, prose(rng, rng.randrange(2, 9)), "en", "x"))
    for i, text in enumerate(pages(rng)):
        rows.append((1000 + i, text, rng.choice(["en", "EN", None, "und"]), "x"))
        cases.add(1000 + i)
    tame = [(2000, prose(rng, 6) + " #garden #boat", "en", "x"), (2001, prose(rng, 5) + " https://www.a.example/b", "en", "x"), (2002, "sofa sofa sofa", "en", "x"), (2003, None, None, None), (2004, "", "en", None), (2005, " \n" * 90, "en", None)]
    rows += tame + [rows[-1]] * 2  # repeated rows
    found = spam_pages(spark.createDataFrame(rows, "doc_id long, text string, lang string, d2 string"))
    got = [r.row_key for r in found.collect()]
    assert sorted(set(got)) == sorted(cases)
    assert len(got) == len(cases) + 2


def test_empty_and_tiny(spark):
    schema = "doc_id long, text string, lang string"
    assert spam_pages(spark.createDataFrame([], schema)).count() == 0
    assert spam_pages(spark.createDataFrame([(1, None, None), (2, "short", "en")], schema)).count() == 0
    assert spam_pages(spark.createDataFrame([(1, "An ordinary sentence that is long enough to be looked at by the operator.", "en")], schema)).count() == 0


def test_words():
    assert words_of("See [sofa](http://a.example/x), now!") == ["see", "sofa", LINK, BREAK, "now", BREAK]
    assert words_of("#tag <a b> 39.90") == [TAG, TAG, CODE]
    assert listed_share(["sofa", "buy", BREAK, "the", "old", "man", "ran"], frozenset({"sofa", "buy"})) == 2 / 6
    assert stuffed(["lamp", "x"] * 8, "en", 8, 0.2) and not stuffed(["lamp"] * 7 + ["x", "y"], "en", 8, 0.2)
    assert not stuffed(["the"] * 30, "en", 8, 0.2)
    assert stuffed(["甲耳机乙", "丙耳机丁"] * 4, "zh", 8, 0.2)


def test_names_of_any_length():
    assert stuffed((["one", "two", "three", "four", "five", "six"] + ["filler"] * 5) * 8, "en", 8, 0.5)
    name = "甲乙丙丁戊己"
    assert stuffed([c + name + d for c, d in zip("子丑寅卯辰巳午未", "天地玄黄宇宙洪荒", strict=True)] + ["春夏秋冬日月星辰" * 9], "zh", 8, 0.35)
    many = [f"{w}的在" for w in "甲乙丙丁戊己庚辛壬"] + ["的在"] * 3 + ["耳机"] * 8  # a commoner sequence of function characters hides nothing
    assert stuffed(many, "zh", 8, 0.2)
    assert not stuffed(["的在"] * 40, "zh", 8, 0.2)


def test_rare_words_and_small_languages(spark):
    """Goods named a few times each in a large core, and a language of six documents, are judged like all others."""
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(3, 9)), "en") for i in range(500)]
    rare = [f"good{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    for i in range(60):
        rows.append((1000 + i, ", ".join(f"buy {w}" for w in rng.sample(rare, 25)), "en"))
    rows += [(2000 + i, "Der alte Müller hat das Rad vor dem Haus in der Nacht mit seinem Sohn und mit der Frau des Nachbarn repariert.", "de") for i in range(5)]
    rows.append((3000, " ".join(["#sofa", "#lampe", "#tisch", "#kessel"] * 12), "de"))
    got = {r.row_key for r in spam_pages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {*range(1000, 1060), 3000}


def test_language():
    of = lambda text, declared: language(text, declared, Counter(words_of(text)))
    assert of("Это утро", "en") == "ru" and of("早上好", None) == "zh" and of("123 !", "en") == "other"
    assert of("the man in the boat", "de") == "en" and of("sofa kettle", "FR-XX") == "fr" and of("sofa kettle", None) == "other"
    for text in ("", "\x00", "💥" * 100, "a" * 50_000, "http://" * 200):
        features(text, None)
