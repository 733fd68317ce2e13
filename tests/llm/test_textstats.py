import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import textstats, tokens
from tessera.llm.textstats import Lexicon, count_chunks, count_text

WORDS = ["the", "of", "and", "it", "is", "的", "我們", "本公司", "可能"]
LEX = Lexicon(WORDS)
PIECES = st.sampled_from([
    "The price of the shares is not known. ", "It is what it is!", " ", "\n", "\n\n", "\n- item one", "\n12. ", "a,b,c\n", "<td>", "</p>", "\t", "本公司可能於明年上市。", "我們", "的", "x" * 70, "word ", "Mr. Who said: “no.” ", "(1) ", "n/a 12.5 ", "{|}~ ",
    "e.g.", "…", "?)", "。」", "very long words without an end ", "the", "<", ">", "<a href='" + "y" * 280 + "'>", "the <b>price</b> of <i class='x y.'>it</i> is ", "<li", " " * 210, "\x1e", "\x1f", "w" * 400, "İs ΟΔΟΣ ", "(" * 66 + "the",
    "it is the way of words " * 50, "<td class='" + "z" * 240 + "'>",
])


def _both(text, cuts):
    return count_chunks(text, sorted(cuts), LEX), count_text(text, LEX)


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=60).map("".join), st.data())
def test_counts_do_not_depend_on_the_cuts(text, data):
    cuts = data.draw(st.lists(st.integers(0, len(text)), max_size=20))
    a, b = _both(text, cuts)
    assert a == b


@pytest.mark.parametrize("size", [1, 2, 7, 97, 500, 3601, 10_000])
@pytest.mark.parametrize("text", [
    "<p>" + "The <a href='https://example.org/one'>share</a> is what it is and <em>the</em> rest of it is not known. " * 200, "word " * 1200 + ". The end is near. ", "<td>a b c.</td>" * 40, "x" * 9000 + " the end of it is near.", "\n \n" * 900 + "The end of it is near.",
    ("It is " + "<i>very</i> " * 130 + "long. ") * 5 + "It is what it is.", "the" * 1300 + " of the",
])
def test_long_stretches_and_inline_tags_at_regular_cuts(text, size):
    text = text[: 600 if size == 1 else None]
    a, b = _both(text, range(size, len(text), size))
    assert a == b


def test_prose_with_inline_tags_is_prose_however_it_is_cut(spark):
    text = "<p>" + "The <a href='https://example.org/one'>share</a> is what it is and <em>the</em> rest of it is not known. " * 100 + "</p>"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = [textstats.text_statistics(df, id="doc_id", text="text", common_words=WORDS, chunk=n, fan=3).collect() for n in (90, 2000, 65_536)]
    assert rows[0] == rows[1] == rows[2] and rows[0][0]["is_prose"] and rows[0][0]["sentence_count"] == 100


def test_a_broken_rule_is_named(spark):
    prose = "It is the price of the share and it is not known. "
    df = spark.createDataFrame([(1, prose), (2, prose + "%%% $$$ " * 3), (3, "a b c d"), (4, "the xxxxxxxxxxxxxxxxxxxxxxxxxxxxx")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["broken_rules"] for r in textstats.text_statistics(df, id="doc_id", text="text", common_words=WORDS).collect()}
    assert got[1] == "" and "symbols" in got[2] and "sentences" in got[3] and "word length" in got[3] and "word length" in got[4]


@settings(max_examples=100, deadline=None)
@given(st.lists(PIECES, max_size=40).map("".join))
def test_words_and_lines_against_brute_force(text):
    c = count_text(text, LEX)
    cjk = [x for x in text if textstats.CJK.match(x)]
    words = textstats.CJK.sub(" ", text).split()
    lines = [x for x in text.split("\n") if x.strip()]
    assert c["words"] == len(words) + len(cjk) and c["chars"] == len("".join(text.split())) and c["lines"] == len(lines)
    starts = sum(any(text.startswith(w, i) for w in WORDS if textstats.CJK.match(w)) for i in range(len(text)))
    assert c["common"] == starts + sum(w.strip(textstats.PUNCTUATION).lower() in LEX.latin for w in words if len(w) <= textstats.LONGEST_WORD)


PROSE = [
    "The offer price was set at HK$19.93 per share, and the net proceeds are estimated at HK$761.4 million. We may not sell before May.",
    "Heron Holdings holds 262,500 shares, Summit Growth holds 47,043,500 shares and Lantern holds 50,832,000 shares. Fold 25 gave IC=0.072, rank IC=0.007, turnover=7.3%; fold 18 gave IC=-0.055.",
    "<p>When we remove the placees from the sample, the signal fell back.</p>\n<p>It is not clear why this is so.</p>",
    "It is not clear why trade count rose steadily while\nparticipation stayed cautious. When we remove local brokers\nfrom the sample, the signal narrowed and its turnover drops\nby 44.64 per cent.",
    "董事會認為匯率波動可能對本集團的業績造成不利影響。我們主要從事電池組件的研發及銷售。", "That was quick! No idea, the vendor feed has been steady all week.",
]
JUNK = [
    "date,vwap,volume\n2026-05-01,-0.027,1\n2026-05-02,0.01,7\ninference chips,10,27", "<table><tr><td>holder</td><td>volume</td></tr><tr><td>Heron</td><td>12</td></tr></table>", "(a) relative spread;\n(b) warehouse systems, Port Ellery;\n(c) terms of this section and of the tranche;",
    '{"volume": {"ts_sum": 0.077, "ok": false}, "vwap": {"ts_sum": -0.016}}', "33714 / 14501 / 44458 / 49851 / 33837", "Next > | Site map | © 2026 | < Previous | Contact | News | Subscribe", "2026-11-16T09:40:45Z WARN job=avg rows=791075 took=3823ms\n2026-04-25T14:43:32Z DEBUG job=avg rows=8 took=65746ms",
    "M|r{e. !'k,.s h[ld[o`t!~ns ove} 51;00~:\\h/res' an[; he::`ca^ b/\\exlrci]ed f\\om \\4.", "heavy back currency rental dependence clearly the trade loss changes rules inventory customer far",
]


@pytest.mark.parametrize(("text", "prose"), [*[(t, True) for t in PROSE], *[(t, False) for t in JUNK]])
def test_prose_and_junk(text, prose):
    c = count_text(text, LEX)
    assert (c["prose_chars"] > 0.5 * (c["chars"] - c["tag_chars"])) is prose


def test_documents_with_huge_empty_and_missing_texts(spark):
    g = random.Random(1)
    huge = "".join(g.choice(PROSE + JUNK) + g.choice([" ", "\n", "\n\n"]) for _ in range(900))
    rows = [(1, huge, "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, " \n\t ", "x", 1), (5, PROSE[0], "x", 1), (6, JUNK[0], "x", 1), (7, "x" * 300_000, "x", 1), (5, PROSE[0], "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, at string, words int")
    out = textstats.text_statistics(df, id="doc_id", text="text", common_words=WORDS, chunk=700, fan=4).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == 8
    c = count_text(huge, LEX)
    assert (got[1]["word_count"], got[1]["sentence_count"]) == (c["words"], c["sentences"]) and got[1]["prose_share"] == pytest.approx(c["prose_chars"] / (c["chars"] - c["tag_chars"]), abs=1e-6)
    assert all(got[i]["word_count"] == 0 and got[i]["is_prose"] is None and got[i]["mean_word_length"] is None for i in (2, 3, 4))
    assert got[5]["is_prose"] is True and got[6]["is_prose"] is False and got[7]["word_count"] == 1 and got[7]["is_prose"] is False
    assert textstats.text_statistics(df.limit(0), id="doc_id", text="text", common_words=[]).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, ""), (3, None), (4, "Title\n\nBody of the text."), (5, "華")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["tokens"], r["lead_tokens"]) for r in tokens.with_tokens(df, "text", {"doc_id": df.doc_id}, lead=True).collect()}
    assert got[1] == (2, 0) and got[2] == got[3] == (0, 0) and got[4][1] == 1 and got[4][0] > 5 and got[5][0] >= 1
    count = tokens.counter("/opt/tokenizers/piece_bpe_32k.model")
    assert count("Hello world") == 2
