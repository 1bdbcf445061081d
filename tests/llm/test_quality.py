import os
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import quality as Q
from quillstone.llm import textstats as T

PROSE = [
    "The display is okay, nothing more and nothing less. We bought this for my partner, who says that it feels solid.",
    "we mostly use it at the weekend so i cannot say much about the lid but a friend from work likes it more than i do",
    "Wir benutzen es meistens am Wochenende, deshalb kann ich noch nicht viel sagen.\nEs gibt bessere, aber auch viele schlechtere.",
    "Lo usamos sobre todo los fines de semana. El ruido está bien, sin más.\n\n- el manual: excelente\n- el peso: estable",
    "Nous nous en servons surtout le week-end, et le colis est arrivé en 30 jours.",
    "値段を考えると、こんなものでしょう。ケーブルが使いにくいので返品しました。",
    "もう少し使ってから書き直します", "Great value", "Enttäuschend", "Geld verschwendet", "返品しました", "Best bike light ever!!! I received it for an honest opinion and it changed my life.",
]
LISTS = ["- easy to clean\n- the strap\n- quiet\n- office chair\n- cheap", "rain jacket\nbaby monitor\nkeyboard\npower bank\nblender\n3 x kettle", "kg: 2%\nh: 52.92\ncolour .... 39%\nV = -\nqty: 11", "the lid, sturdy, cheap, 3 x kettle, the base +, keyboard, wobbly, desk lamp", "音 +, リュック, 使いにくい, ひどい, エアベッド, 寝袋, 電気ケトル, 重さ -"]
TABLES = ["| a | b | c |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| 4 | 5 | 6 |", "w\tmodel\tkg\n98.35\t920\t-\n2539\t-\t-\n-\tA72\t-", "kg,w,kg\nX281;0.48;50.30\n82%;83.81;85.47\n4947;x;A325", "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>", "It is okay, nothing more and nothing less.\n\n| V | w | qty | kg |\n| --- | --- | --- | --- |\n| 1 | 2 | 3 | 44.50 |\n| 4 | 5 | 6 | 21.3 |\n| 41% | 70.08 | - | 75.13 |\n| 79.43 | - | - | X119 |"]
JUNK = ["hggkkkklgjda jhllshsjfd gaagfafkdga aghjlg", "🔥👍😂🔥💯🎉🔥😂🎉😂💯❤💯😂", "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "========================", "a7 26 d8 e6 b5 87 f2 3e 93 0c 09 77", "gut gut gut gut gut gut gut gut gut gut gut gut", "3gWDnaXkG9ZosYBf60S4hefjcyjMtDc85n0IwvKgeIMTIDTAJjMzEp+kuRPQmw1ptsqd+gLfzDT==", "%A3%DB%98+%AE%80%91+%F9+%EE%C1%86%BE%B2", "ERR 0x5266f5 [w56] rc=246 (5012ms)\nWARN 0x078401 [w35] rc=63 (4427ms)\nINFO 0x11 [q2] rc=9 (88ms)"]
JUNK += ["ldf hfahdkj ljflhdsds ashg djjghhaaaks kkd fdddlfgl safdgkd dajfajjj", "sdgd skkfaflkghhl shffdhjg hskllddk jakkkakjjsa", "Joqywovoqy Fovukykyzu Fowu Qubywyku;; Xowy. Jyqozy. Zukukoby;; Wufojuvu~ Xoqozyzy~", "Kuboqujy~ Xyzy. Bowyky. Fywyvoko Joqyfuxuvy. Wyzuzu Zywuvu Zujukozy~ Xykokuxo", "Fyjyzybu. Woqy Qowobuqy~ Qojoxobo~ Fobuxywo;; Jyzuvo. Buvojozo~ Xozyjo Fyqu", "item item item item item item item item item item item item item", "bien bien bien bien bien bien bien bien bien bien", "qLd8o5wIQKKdNslFYcdOPNdCULDGK7uYlqyrXU3o=="]
SCHEMA = "doc_id long, text string, s string, v string, key string, parts string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in enumerate(texts)], SCHEMA)


def types(spark, texts):
    return {r["doc_id"]: r for r in Q.text_types(frame(spark, texts), "doc_id", "text").collect()}


def test_statistics(spark):
    r = types(spark, ["It is good.\nAnd cheap"])[0]
    assert (r["n_chars"], r["n_lines"], r["n_words"], r["n_distinct_words"]) == (21, 2, 5, 5)
    assert r["mean_word_length"] == pytest.approx(3.2) and r["ended_line_share"] == 0.5
    assert r["symbol_ratio"] == pytest.approx(1 / 17) and r["common_word_ratio"] is None


def test_blank_repeated_and_empty(spark):
    got = types(spark, [None, "", "  \r\n ", "\t", "Good value", "Good value"])
    assert all(got[i]["text_type"] is None and got[i]["p_prose"] is None and got[i]["n_words"] == 0 for i in range(4))
    assert got[4]["text_type"] == got[5]["text_type"] == "prose"
    assert types(spark, []) == {} and all(r["text_type"] is None for r in types(spark, [None, ""]).values())


def test_very_long_texts(spark):
    long = [("The weight is okay, and we use it at home. " * 20_000), "the lid\n" * 30_000, "x" * 500_000, "- item one\n" * 20_000]
    got = types(spark, long + PROSE)
    assert got[0]["n_words"] == 200_000 and got[3]["text_type"] == "list"


OTHER_LANGUAGES = [
    "Мы пользуемся чайником каждый день, и пока он работает без замечаний. Крышка закрывается плотно, но ручка могла бы быть удобнее.",
    "매일 아침 이 주전자를 쓰고 있는데 아직 아무 문제가 없습니다. 뚜껑은 잘 닫히지만 손잡이는 조금 불편합니다.",
    "Używamy tego czajnika codziennie i na razie działa bez zarzutu. Pokrywka dobrze się zamyka, ale uchwyt mógłby być wygodniejszy.",
    "نستخدم هذا الإبريق كل يوم وهو يعمل جيدا حتى الآن. الغطاء يغلق بإحكام لكن المقبض غير مريح قليلا.",
    "Bu su ısıtıcısını her gün kullanıyoruz ve şimdiye kadar sorunsuz çalışıyor. Kapağı iyi kapanıyor ama sapı daha rahat olabilirdi.",
    "Usiamo questo bollitore tutti i giorni e per ora funziona bene. Il coperchio si chiude bene, ma il manico potrebbe essere più comodo.",
    "Usamos esta chaleira todos os dias e até agora funciona bem. A tampa fecha bem, mas a pega podia ser mais confortável.",
    "We gebruiken deze waterkoker elke dag en tot nu toe werkt hij goed. Het deksel sluit goed, maar het handvat kan beter.",
    "我们每天都用这个水壶，到目前为止没有任何问题。盖子关得很紧，但是把手可以更舒服一些。",
]


DATA = "/root/testdata/sf0.01/documents.parquet"
needs_documents = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
PLANTED = [(t, k) for k, g in enumerate((PROSE, LISTS, TABLES, JUNK)) for t in g]
LANGUAGES = ["ru", "ko", "pl", "ar", "tr", "it", "pt", "nl", "zh"]


def corpus(spark):
    """The documents of the small tables with planted texts, whose ids are negative."""
    rows = [(-1 - i, t, "en" if t.isascii() else None) for i, (t, _) in enumerate(PLANTED)]
    rows += [(-1001 - i, t, g) for i, (t, g) in enumerate(zip(OTHER_LANGUAGES, LANGUAGES))]
    return spark.read.parquet(DATA).select("doc_id", "text", "lang").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


@needs_documents
def test_planted_texts_and_prose_in_languages_without_words_learned(spark):
    got = {r["doc_id"]: r for r in Q.text_types(corpus(spark), "doc_id", "text", "lang").where("doc_id < 0").collect()}
    assert not {(t[:40], got[-1 - i]["text_type"]) for i, (t, k) in enumerate(PLANTED) if (got[-1 - i]["text_type"] == "prose") != (k == 0)}
    assert [got[-1001 - i]["text_type"] for i in range(len(LANGUAGES))] == ["prose"] * len(LANGUAGES)
    for r in got.values():
        assert sum(r[f"p_{t}"] for t in Q.TYPES) == pytest.approx(1)


@needs_documents
def test_learning_decides_and_is_better(spark):
    """On planted cases EM differs from untrained functions and from a majority of votes, and errs less."""
    voted = Q._voted(corpus(spark), "doc_id", "text", "lang")
    patterns, frequency, theta = Q._fitted(voted)
    of = {tuple(p): i for i, p in enumerate(patterns.tolist())}
    at = np.array([of[tuple(r["v"])] for r in sorted(voted.where("key between -999 and -1").collect(), key=lambda r: -r["key"])])
    truth = np.array([k for _, k in PLANTED]) != 0
    named = Q.named_types()
    votes = np.array([[sum((c in v) / len(v) for j, vs in enumerate(named) for i, v in enumerate(vs) if p[j] == i + 1) for c in range(4)] for p in patterns])
    wrong = lambda post: int(((post.argmax(1) != 0)[at] != truth).sum())
    learned, untrained = wrong(Q.posterior(patterns, frequency, theta)), wrong(Q.posterior(patterns, np.full(4, 0.25), Q.untrained(named)))
    assert learned == 0 and untrained >= 2 and wrong(votes) >= 2


def test_common_words_are_learned_per_language(spark):
    """Nonsense lacks the words of its language, which no list gives."""
    rng = np.random.default_rng(5)
    syllables = ["ba", "ko", "ri", "tu", "me", "sa", "no", "vi", "lo", "pe", "da", "gu"]
    word = lambda k: "".join(rng.choice(syllables, k))
    usual = {g: [word(2) for _ in range(15)] for g in ("xa", "yb")}

    def text(known):
        return " ".join(rng.choice(known) if known and rng.random() < 0.5 else word(int(rng.integers(2, 5))) for _ in range(30)) + "."

    rows = [(i, text(usual[g]), g) for i, g in enumerate(["xa", "yb"] * 150)]
    rows += [(1000 + i, text([]).title()[:-1], g) for i, g in enumerate(["xa", "yb", None] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in Q.text_types(df, "doc_id", "text", "lang").collect()}
    ratio = lambda ids: np.array([got[i]["common_word_ratio"] for i in ids])
    assert (ratio(range(300)) > 0.55).mean() > 0.95 and (ratio(range(1000, 1015)) < 0.55).all()


def test_em_learns_accuracies():
    """Simulated labelling functions: their accuracies and the types are recovered."""
    rng = np.random.default_rng(1)
    n, right = 20_000, np.array([0.95, 0.9, 0.75, 0.6, 0.85])
    truth = rng.choice(4, n, p=[0.7, 0.1, 0.1, 0.1])
    votes = np.zeros((n, 5), int)
    for j, a in enumerate(right):
        ok = rng.random(n) < a
        votes[:, j] = 1 + np.where(ok, truth, (truth + rng.integers(1, 4, n)) % 4)
        votes[rng.random(n) < 0.3, j] = 0
    pats, counts = np.unique(votes, axis=0, return_counts=True)
    frequency, theta = Q.fit_accuracies(pats, counts.astype(float), [[(0,), (1,), (2,), (3,)]] * 5)
    got = np.array([[theta[j][c, 1 + c] for c in range(4)] for j in range(5)])
    assert np.abs(got - right[:, None]).max() < 0.08 and np.abs(frequency - [0.7, 0.1, 0.1, 0.1]).max() < 0.03
    assert (Q.posterior(votes, frequency, theta).argmax(1) == truth).mean() > 0.9


CHARS = st.sampled_from(list("aBcé ñ'’.,;:!?-*#|\t\n\r0١9ßЖд한글漢字かなカナー。、・🔥\u0301\u200b\x85<>/=()[]"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(CHARS, max_size=60), min_size=1, max_size=6))
def test_statistics_equal_those_counted_one_by_one(texts):
    got = T.statistics(texts, np.zeros(0, np.int64), np.full(len(texts), np.nan))
    for i, t in enumerate(texts):
        assert got["n_chars"][i] == len(t)
        t = re.sub(r"(?i)</(?:tr|li|p|div|h\d)>|<br\s*/?>", "\n", t)
        cat = [unicodedata.category(c) for c in t]
        seen = [k[0] not in "ZC" and not c.isspace() for c, k in zip(t, cat)]
        lines = re.split("[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", t)
        real = [x for x in lines if any(unicodedata.category(c)[0] not in "ZC" and not c.isspace() for c in x)]
        wide = [(unicodedata.name(c, "").startswith(("CJK", "HIRAGANA", "KATAKANA")) and unicodedata.category(c)[0] == "L") or c == "ー" for c in t]
        plain = "".join(" " if w else c for c, w in zip(t, wide))
        alpha = lambda c: unicodedata.category(c)[0] in "LM" and not 0xFE00 <= ord(c) <= 0xFE0F
        body = "".join(c if alpha(c) or (c in "'’" and 0 < j < len(plain) - 1 and alpha(plain[j - 1]) and alpha(plain[j + 1])) else " " for j, c in enumerate(plain))
        words = [w.lower() for w in body.split(" ") if w]
        pairs = [t[j : j + 2] for j in range(len(t) - 1) if wide[j] and wide[j + 1]]
        n = sum(seen)
        share = lambda k: k / n if n else 0.0
        assert got["n_lines"][i] == len(real)
        assert got["n_words"][i] == len(words) + len(pairs) and got["n_distinct_words"][i] == len({*words, *pairs})
        assert got["letter_ratio"][i] == pytest.approx(share(sum(k[0] == "L" or c == "ー" for c, k in zip(t, cat))))
        assert got["digit_ratio"][i] == pytest.approx(share(sum(k[0] == "N" for k in cat)))
        assert got["mean_word_length"][i] == pytest.approx(np.mean([len(w) for w in words]) if words else 0)
        assert got["cell_share"][i] <= 1 and 0 <= got["ended_share"][i] <= 1


def test_statistics_do_not_depend_on_the_neighbours():
    texts = (PROSE + LISTS + TABLES + JUNK + ["", " ", "\n\n", "x" * 70_000, "a b\n" * 30_000]) * 2
    whole = T.statistics(texts, np.zeros(0, np.int64), np.full(len(texts), np.nan))
    for i, t in enumerate(texts):
        one = T.statistics([t], np.zeros(0, np.int64), np.full(1, np.nan))
        assert all(np.array_equal(one[f][0], whole[f][i], equal_nan=True) for f in one if f not in T.COUNTS) and all(one[f][0] == whole[f][i] for f in T.COUNTS)


def test_heads_and_marks_of_lines():
    share = lambda t, f: T.statistics([t], np.zeros(0, np.int64), np.full(1, np.nan))[f][0]
    for head in ("- ", "• ", "1. ", "12) ", "(3) ", "a) ", "#4 ", "[ ] ", "[x] ", "+ "):
        assert share(f"{head}the lid", "bullet_share") == 1, head
    for text in ("-5 degrees", "1.5 kg", "a lid", "#tag", "(see below)", "e.g. this"):
        assert share(text, "bullet_share") == 0, text
    assert share("| a | b |\nprose here.", "cell_share") == pytest.approx(5 / 15)
    assert share("kg: 5\nmax .... 3\nV = -", "pair_share") == 1 and share("He said: that is enough.", "pair_share") == 0
