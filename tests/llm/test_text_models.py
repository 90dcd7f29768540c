"""HTML extraction, language-model scores, classifier and chat repair."""

import itertools
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewire.llm import chat, html_text, lm_scoring, quality_classifier
from tidewire.llm.tables import read

# --------------------------------------------------------------------------
# HTML
# --------------------------------------------------------------------------

LONG = "A sentence that is long enough to look like running text and so to make a surge."
FURNITURE = (
    "<header><h2>Site</h2><p>{x}</p></header>",
    "<nav><ul><li><a href='/a'>{x}</a></li></ul></nav>",
    "<div class='cookie-notice'><p>{x}</p></div>",
    "<aside>{x}</aside>",
    "<div id=sidebar><p>{x}</p></div>",
    "<div class=\"ad\">{x}</div>",
    "<form><p>{x}</p><input value=q></form>",
    "<script>var x = '<p>{x}</p>';</script>",
    "<style>p {{content: '{x}'}}</style>",
    "<section class='comments'><h3>Comments</h3><p>{x}</p></section>",
    "<footer>{x}</footer>",
    "<!-- <p>{x}</p> -->",
    "<div role=navigation>{x}</div>",
    "<div hidden>{x}</div>",
)


@pytest.mark.parametrize("part", FURNITURE)
@pytest.mark.parametrize("main", ["<article>{}</article>", "<main>{}</main>", "<div class='content'>{}</div>"])
def test_furniture_goes(part, main):
    body = main.format(f"<h1>Head &amp; line</h1><p>{LONG}<p>Two&nbsp; <b>bold</b>\n words &lt;x&gt;<br>after {LONG}</p>")
    page = f"<html><body>{part.format(x='Noise ' + LONG)}{body}{part.format(x='Noise ' + LONG)}"
    assert html_text.main_text(page) == f"Head & line\n\n{LONG}\n\nTwo bold words <x> after {LONG}"


def test_odd_pages():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("plain &eacute; text") == "plain é text"
    assert html_text.main_text("<p>unclosed <b>bold <i>text") == "unclosed bold text"
    assert html_text.main_text("<article><p>a</p><nav>n</nav>" + "<aside>x</aside>" * 9 + "<p>z</p></article>") == "a\n\nz"
    assert html_text.main_text("<div " + "x" * 200_000) == ""
    assert html_text.main_text("<div>" * 20_000 + "deep") == "deep"
    assert html_text.main_text("<a href=\"x>y\">1 < 2</a>") in ("1 < 2", "")
    many = "<article>" + "<p>w</p>" * 20_000 + "</article>"
    assert html_text.main_text(many).count("w") == 20_000


def test_linked_lines_between_surge_and_dive_stay():
    link, advert = "<p><a href='/r'>Full report</a></p>", "<div class=ad><p>x</p><p>y</p><p>z</p></div>"
    page = f"<div><p>{LONG}</p>{link}<p>{LONG}</p></div>"
    assert html_text.main_text(page) == f"{LONG}\n\nFull report\n\n{LONG}"
    # Furniture separates nothing, so a short paragraph between adverts belongs to the text around them.
    page = f"<div><p>{LONG * 20}</p>{advert}<p>Short.</p>{advert}<p>{LONG}</p></div>"
    assert html_text.main_text(page) == f"{LONG * 20}\n\nShort.\n\n{LONG}"


def test_weight_is_text_outside_of_links():
    page = "<p>five <a href='/a'>" + "&amp;\n  " * 20 + "</a> six</p><p><a>only <b>a link</b></a> <a>and</a></p>"
    assert [size for _, size, _, _ in html_text.lines(page)] == [len("five six"), 0]


def test_unclosed_head_and_camel_case_marks():
    assert html_text.main_text("<html><head><title>x</title><body><article><p>Hello</article>") == "Hello"
    assert html_text.main_text("<html><head><meta charset=utf-8><title>x</title><p>Hello") == "Hello"
    assert html_text.main_text("<head><title>x</title></head><title>y</title>plain") == "plain"
    for mark in ("commentSection", "usercomments", "user-comment", "sideBar", "pageFooter"):
        assert html_text.main_text(f"<div class='{mark}'><p>{LONG}</p></div><p>Text. {LONG}</p>") == f"Text. {LONG}"


def test_teasers_do_not_bound_the_search():
    paragraphs = [f"{i} {LONG}" for i in range(10)]
    teaser = "<article><p>Read more about it.</p></article>"
    page = "<div>" + "".join(f"<p>{x}</p>" for x in paragraphs) + f"</div>{teaser}"
    assert html_text.main_text(page) == "\n\n".join([*paragraphs, "Read more about it."])
    # An article that weighs most bounds the search: lines beside it are no part of the text.
    page = f"<p>Beside it.</p><article><p>{LONG}</p><p><a>All linked</a></p><p>x</p></article><p>Beside it.</p>"
    assert html_text.main_text(page) == f"{LONG}\n\nAll linked\n\nx"


@pytest.mark.parametrize(
    "page",
    ["<div>" * 200_000, "<div>" * 90_000 + "</b>" * 120_000, "<b>" * 100_000 + "<p></p>" * 100_000, "<b><div>" + "<i>" * 150_000 + "</b>" * 120_000],
)
def test_deep_markup_takes_linear_time(page):
    start = time.process_time()
    assert html_text.main_text(page + f"<p>{LONG}") == LONG
    assert time.process_time() - start < 10


def _plain_text(parts):
    """Main text by the rule itself: lines between dives around every window whose sum is a surge."""
    inside = sum(len(text) for text, _, article in parts if article)
    outside = sum(len(text) for text, linked, article in parts if not article and not linked)
    shown = [p for p in parts if p[2]] if inside and inside >= outside else parts
    weight = [0 if linked and not article else len(text) for text, linked, article in shown]

    def total(i):
        return sum(weight[j] for j in range(i, min(i + html_text.WINDOW, len(shown))) if all(shown[k][2] == shown[i][2] for k in range(i, j + 1)))

    totals = [total(i) for i in range(len(shown))]
    limit = min(html_text.SURGE, html_text.SHARE * max(totals, default=0))
    kept = []
    for i in range(len(shown)):
        low = high = i
        while low > 0 and totals[low - 1] and shown[low - 1][2] == shown[i][2]:
            low -= 1
        while high + 1 < len(shown) and totals[high + 1] and shown[high + 1][2] == shown[i][2]:
            high += 1
        if totals[i] and any(totals[j] > (0 if shown[i][2] else limit) for j in range(low, high + 1)):
            kept.append(shown[i][0])
    return "\n\n".join(kept)


def test_random_pages_against_the_rule():
    random_ = random.Random(7)
    for _ in range(400):
        parts, page = [], ""
        for _ in range(random_.randint(1, 6)):
            article = random_.random() < 0.4
            rows = []
            for _ in range(random_.randint(1, 7)):
                text, linked = "w" * random_.choice((1, 4, 30, 400, 3000)), random_.random() < 0.5
                rows.append((text, linked, article))
            inner = "".join(f"<p><a href=x>{t}</a></p>" if linked else f"<p>{t}</p>" for t, linked, _ in rows)
            page += f"<article>{inner}</article>" if article else f"<div>{inner}</div>"
            parts += rows
            if random_.random() < 0.3:
                page += f"<aside><p>{LONG}</p></aside>"
        assert html_text.main_text(page) == _plain_text(parts)


def test_extract(spark):
    rows = [(1, "u", f"<article><p>{LONG}</p></article>", "t"), (None, None, None, "t"), (1, "u", f"<article><p>{LONG}</p></article>", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_text.extract(pages)
    assert [f.dataType.simpleString() for f in out.schema] == ["bigint", "string", "string", "bigint"]
    assert Counter(map(tuple, out.collect())) == Counter({(1, "u", LONG, len(LONG)): 2, (None, None, "", 0): 1})
    assert html_text.extract(pages.limit(0)).count() == 0


# --------------------------------------------------------------------------
# Language model
# --------------------------------------------------------------------------


def lm_rows():
    pick = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    follow = {w: pick.choices(words, k=3) for w in words}
    rows = []
    for i in range(160):
        w, out = pick.choice(words), []
        for _ in range(pick.randrange(0, 200)):
            out.append(w.upper() if pick.random() < 0.1 else w)
            w = pick.choice(follow[w])
        rows.append((i, pick.choice((" ", "\n")).join(out)))
    return rows + [(1000, None), (1001, ""), (None, "w1 w2 w3"), (3, rows[3][1]), (1002, "É é unknown\x0bwords " * 3), (1003, "again " * 5000)]


def test_lm_scores(spark):
    rows = lm_rows()
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    got = lm_scoring.scored(docs).collect()
    assert len(got) == len(rows)
    tokens = {(repr(d), (t or "")): [*(t or "").encode().lower().split(), b""] for d, t in rows}
    counts = Counter()
    for doc, text in rows:
        if doc is None or zlib.crc32(str(doc).encode()) % 7 != 2:
            counts.update(tokens[repr(doc), text or ""])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for doc, text in rows:
        words = tokens[repr(doc), text or ""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        held = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 2
        expected.append((repr(doc), held, len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    assert sorted(expected) == sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and (r.bits_per_byte is None) == (r.n_tokens == 1) for r in got)
    again = next(r for r in got if r.doc_id == 1003)
    assert again.score > 0.1 * again.base_score  # it adapts to a text that repeats itself


def test_lm_probabilities_sum_to_one():
    """After any beginning of a text, the probabilities of all cells sum to one."""
    random_ = np.random.default_rng(4)
    tables = [lm_scoring.prefix_totals(random_.integers(0, most, lm_scoring.CELLS)) for most in (90, 9, 2)]
    start = random_.integers(0, lm_scoring.CELLS, 190)

    def score(cells):
        zeros = np.zeros(len(cells), dtype=np.int64)
        totals = [t[cells] for t in tables[1:]]
        return [x[0] for x in lm_scoring.mixed(cells, zeros, np.arange(len(cells)) // 64, totals, tables[0], zeros > 0)]

    before = score(start)
    after = [score(np.append(start, cell)) for cell in range(lm_scoring.CELLS)]
    for i in range(2):
        assert abs(sum(10 ** (x[i] - before[i]) for x in after) - 1) < 1e-4


def lm_blocks(spark, rows):
    """Coded blocks and what they get back, made in plain calls with 40 bits of the hash and 16 ranges."""
    docs = spark.createDataFrame(rows, "doc_id string, held boolean, text string")
    blocks = docs.repartition(3).mapInPandas(lm_scoring._coded, lm_scoring._BLOCK).toPandas()
    sent, words = pd.concat(lm_scoring._sent([blocks], 40, 4)), pd.concat(lm_scoring._sent_words([blocks], 4))
    totals = [lm_scoring._totals(group) for _, group in sent.groupby(["kind", "part"])]
    totals += [lm_scoring._word_totals(group) for _, group in words.groupby("part")]
    return blocks, pd.concat(totals).sort_values("part")


def lm_totals(block, extra, number, kind):
    """Rows of counts that share 0, 1, .. bits, one per distinct pair of a block."""
    packed = [x for row in extra["totals"][(extra["kind"] == kind) & (extra["block"] == number)] for x in row]
    parts = [np.frombuffer(b"".join(map(zlib.decompress, packed[i::7])), dtype=np.uint8) for i in range(7)]
    return np.cumsum(lm_scoring._STEPS[np.stack(parts, axis=1)], axis=1)[:, ::-1]


def test_lm_counts_of_contexts(spark):
    """Totals of every pair, prefix and word against counting, over several blocks."""
    rows = [(str(i), i % 5 == 0, text) for i, (_, text) in enumerate(lm_rows()[:80])]
    blocks, extra = lm_blocks(spark, rows)
    opened = {row.block: lm_scoring._Block(row, 40) for row in blocks.itertuples()}
    for kind in range(2):
        counts = Counter()
        for block in opened.values():
            for pair, doc in zip(block.pairs[kind].tolist(), block.doc[block.coded], strict=True):
                if not block.held[doc]:
                    counts.update((bit, pair >> bit) for bit in range(7))
        for number, block in opened.items():
            expected = [[counts[6 - i, pair >> 6 - i] for i in range(7)] for pair in np.unique(block.pairs[kind]).tolist()]
            got, expected = lm_totals(block, extra, number, kind), np.array(expected)
            assert (got[expected < 16] == expected[expected < 16]).all()
            assert np.allclose(got, expected, rtol=0.1)
    tokens, types = Counter(), set()
    for row in blocks.itertuples():
        for h1, h2, n in zip(row.h1, row.h2, row.n, strict=True):
            tokens[int(h1) % 2**64 >> 58] += n
            types |= {(h1, h2)} if n else set()
    sums = np.sum([x for x in extra["sums"] if x is not None], axis=0).tolist()
    by_cell = Counter(int(h1) % 2**64 >> 58 for h1, _ in types)
    assert sums == [tokens[c] for c in range(64)] + [by_cell[c] for c in range(64)]


def plain_cells(cells, totals, root, own, places):
    """Log10 probability of the cells of one text, decision by decision, with and without own events."""
    weights = [list(row) for _ in range(6) for row in lm_scoring.START]
    chart = [[1 / (1 + math.exp(-(b + 0.5) / 1.5)) for b in range(16)] for _ in range(6)]
    text, scores = Counter(), [0.0, 0.0]
    for chunk in sorted(set(places)):
        gradient, came, later = defaultdict(float), defaultdict(list), []
        for i in (i for i, c in enumerate(places) if c == chunk):
            for place in range(6):
                prefix = 1 << place | cells[i] >> (6 - place)
                bit = cells[i] >> (5 - place) & 1
                base = (root[cells[i]][place + 1] + 0.4) / (root[cells[i]][place] + 0.8)
                hits, misses = text[prefix, bit], text[prefix, 1 - bit]
                times = totals[1][i][place] - own
                gate = place * 4 + (times > 0) + (times > 2) + (times > 15)
                for which, less in ((0, 0), (1, own)):
                    values = [base]
                    for table in totals:
                        p = (table[i][place + 1] - less + 2 * values[-1]) / (table[i][place] - less + 2)
                        values.append(min(max(p, 1e-6), 1 - 1e-6))
                    values.append(min(max((hits + 4 * base) / (hits + misses + 4), 1e-6), 1 - 1e-6))
                    x = [math.log(p / (1 - p)) for p in values]
                    logit = min(max(sum(w * v for w, v in zip(weights[gate], x, strict=True)), -12), 12)
                    q = 1 / (1 + math.exp(-logit))
                    bucket = min(int(abs(logit) * 1.5), 15)
                    favoured = logit > 0 or (logit == 0 and bit == 1)
                    refined = chart[place][bucket] if favoured else 1 - chart[place][bucket]
                    scores[which] += math.log10(min(max((q + refined) / 2, 1e-6), 1 - 1e-6))
                for k, v in enumerate(x):
                    gradient[gate, k] += (1 - q) * v
                came[place, bucket].append(favoured)
                later.append((prefix, bit))
        for (gate, k), v in gradient.items():
            weights[gate][k] += min(max(0.004 * v, -0.2), 0.2)
        for (place, bucket), seen in came.items():
            mean = sum(seen) / len(seen)
            chart[place][bucket] += (1 - 0.98 ** len(seen)) * (mean - chart[place][bucket])
        text.update(later)
    return scores


def plain_matches(tokens):
    """Log10 probability of the match decisions of one text, and which tokens came as expected."""
    last, trust, tally, score, matched, before = {}, {}, defaultdict(lambda: [0, 0]), 0.0, [], None
    for token in tokens:
        hit = False
        if before in last:
            kind = trust[before]
            hits, times = tally[kind]
            p = (hits + 4 * lm_scoring.MATCH_RATES[kind]) / (times + 4)
            hit = last[before] == token
            score += math.log10(p if hit else 1 - p)
            tally[kind] = [hits + hit, times + 1]
            trust[before] = 1 + hit
        else:
            trust[before] = 0
        last[before], before = token, token
        matched.append(hit)
    return score, matched


def test_lm_scores_against_plain_mixing(spark):
    rows = [(str(i), i % 5 == 0, text) for i, (_, text) in enumerate(lm_rows()[:60])]
    rows.append(("again", False, "again and " * 300))
    blocks, extra = lm_blocks(spark, rows)
    cells, types = np.split(np.sum([x for x in extra["sums"] if x is not None], axis=0), 2)
    root = lm_scoring.prefix_totals(cells)
    for i, row in enumerate(blocks.itertuples()):
        one = blocks.iloc[i : i + 1].drop(columns=["h2", "n"])
        got = lm_scoring._scored(one, extra[extra["block"] == row.block], 40, cells, types)
        block = lm_scoring._Block(row, 40)
        count = {h: 0 for h in row.h1}
        for other in blocks.itertuples():
            count.update({h: count[h] + n for h, n in zip(other.h1, other.n, strict=True) if h in count})
        tables = [
            lm_totals(block, extra, row.block, kind)[np.unique(block.pairs[kind], return_inverse=True)[1]] for kind in range(2)
        ]
        for doc in range(len(block.lengths)):
            tokens = block.tokens[block.ends[doc] : block.ends[doc + 1]].tolist()
            match, matched = plain_matches(tokens)
            coded = [i for i, hit in enumerate(matched) if not hit]
            rows_of = np.flatnonzero(block.doc[block.coded] == doc)
            assert (block.coded[rows_of] - block.ends[doc]).tolist() == coded
            cell = block.cell[block.coded[rows_of]].tolist()
            own = int(not block.held[doc])
            scores = plain_cells(cell, [t[rows_of] for t in tables], root, own, [i // 64 for i in coded])
            for name, score, less in (("score", scores[0], 0), ("left", scores[1], own)):
                for at, c in zip(coded, cell, strict=True):
                    score += math.log10((count[row.h1[tokens[at]]] - less + 1) / (cells[c] + types[c] + 1 - less))
                assert got[name].iloc[doc] == pytest.approx(score + match, rel=2e-3, abs=2e-3)


def test_lm_sets_copies_apart(spark):
    """Texts that occur twice have fewer bits than texts that occur once, learnt from or held out."""
    pick = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(pick.choices(words, k=150)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:30])), "doc_id long, text string")
    bits = {r.doc_id: r.bits_per_byte for r in lm_scoring.scored(docs).collect()}
    held = {i for i in bits if zlib.crc32(str(i).encode()) % 7 == 2}
    # A copy of a held-out text alone is not in the counts.
    copies = [i for i in [*range(30), *range(300, 330)] if (i + 300 if i < 30 else i - 300) not in held]
    assert max(bits[i] for i in copies) < min(bits[i] for i in range(30, 300))


def test_lm_rounds_totals_of_any_size():
    numbers = np.array([0, 1, 15, 16, 17, 100, 70_000, 2**24 + 9, 2**40, 2**62])
    assert np.allclose(lm_scoring._STEPS[lm_scoring._rounded(numbers)], numbers, rtol=0.1)
    assert lm_scoring._STEPS[lm_scoring._rounded(np.arange(16))].tolist() == list(range(16))


def test_lm_packs_numbers_of_any_size():
    for most in (1, 200, 70_000, 2**24 + 9, 2**40):
        numbers = np.random.default_rng(1).integers(0, most, 50)
        assert lm_scoring._unpacked(lm_scoring._packed(numbers)).tolist() == numbers.tolist()
    assert len(lm_scoring._unpacked(lm_scoring._packed(np.zeros(0, dtype=int)))) == 0


def test_lm_of_nothing(spark):
    assert lm_scoring.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lm_without_training(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lm_scoring.scored(spark.createDataFrame([(held, "a b")], "doc_id long, text string")).first()
    assert (row.train_tokens, row.n_known, row.base_score) == (0, 0, 0.0) and row.score <= 0


# --------------------------------------------------------------------------
# Classifier
# --------------------------------------------------------------------------


def test_classifier_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    found = quality_classifier.scored(docs, labels)
    rows = found.join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows)
    assert right >= 0.95 * len(rows) and {r.predicted for r in rows} == {0, 1}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found.collect())


def test_compiled_rules_are_the_rules(spark):
    docs = spark.createDataFrame([(1, "a b!"), (2, "### $$$"), (3, None)], "doc_id long, text string")
    stats = quality_classifier.statistics(docs, ("doc_id",))
    rules = [(((4, ">", 0.5),), -2.0), (((0, "<=", 1.5), (5, ">", 0.1)), 1.0)]
    column = quality_classifier.score_column(0.25, rules)
    for row in stats.select("*", column.alias("score")).collect():
        z = 0.25 - 2.0 * (row.stat_symbol > 0.5) + 1.0 * (row.stat_log_words <= 1.5 and row.stat_bang > 0.1)
        assert row.score == pytest.approx(1 / (1 + math.exp(-z)))


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(None, 1, 0), (1, None, 0), (77, 0, 0)]])
def test_classifier_with_few_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (None, None, 9), (2, "", 9)], "doc_id long, text string, label int")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality_classifier.scored(docs, marks).collect()
    assert len(rows) == 4 and all(0 < r.score < 1 for r in rows)
    assert quality_classifier.accepted(docs, marks).columns == docs.columns
    assert quality_classifier.scored(docs.limit(0), marks).count() == 0


# --------------------------------------------------------------------------
# Chat
# --------------------------------------------------------------------------


@pytest.mark.parametrize("segment", [1024, 2])
def test_least_cost_repair(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    pick = random.Random(1)
    rows = [
        (
            c or None,
            k if pick.random() < 0.9 else None,
            pick.choice(["user", "assistant", "system", "Human ", None, "x"]),
            pick.choice(["a", "", None, "b<|im_end|>"]),
            1,
        )
        for c in range(25)
        for k in range(pick.randint(1, 6))
    ]
    rows += rows[:4]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")
    by_talk = defaultdict(list)
    for r in chat.repaired(talks).collect():
        by_talk[r.conv_id].append(r)
    assert sum(map(len, by_talk.values())) == len(set(rows))
    for turns in by_talk.values():
        turns.sort(key=lambda r: (r.segment, r.part, r.place))
        known = [chat._known(r.role) for r in turns]
        paths = itertools.product(range(3), repeat=len(turns))
        costs = (sum(chat.CHOICES[k].get((a, b), (99,))[0] for k, a, b in zip(known, (chat.START, *p), p)) for p in paths)
        assert min(costs) == sum(r.cost for r in turns)
        text = "".join(r.rendered for r in turns)
        assert text.count("<|im_start|>") == text.count("<|im_end|>")
        roles = [x.split("\n")[0] for x in text.split("<|im_start|>")[1:]]
        rest = roles[1:] if roles[0] == "system" else roles
        assert all(x == ("user", "assistant")[i % 2] for i, x in enumerate(rest))


def test_legal_talk_stays(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    out = chat.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    assert [r.action for r in out] == ["keep"] * 3
    assert "".join(r.rendered for r in out) == (
        "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    )


def test_one_turn_number_for_many_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 8)
    talks = spark.range(400).select(
        F.lit(1).alias("conv_id"), F.lit(5).alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text")
    )
    out = chat.repaired(talks).collect()
    assert len(out) == 400 and len({r.part for r in out}) > 50
    assert sum(r.cost for r in out) == 399 * chat.MERGE


def test_no_talks(spark):
    assert chat.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
