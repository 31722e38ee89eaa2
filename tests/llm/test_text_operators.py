"""Operators on single rows: against the public libraries, brute force, round trips; edge cases of all of them."""

import base64
import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import bpe, decontaminate, html_consensus, language, prefix_counts, repetition, toxicity, warc

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", " ", "  ", "\n", "\t", "'s", "'ll", "'", "1", "é", "<|endoftext|>", "\xa0", "the", " and", "\x1c", "日本", "!", "🙂", "́", "²", "\x85", "q", "zq", "ing", "'re"]
EDGES = [None, "", " \n\t", "word", "Ünïcode \U0001f642 text", "x" * 5000, "tick tock " * 3000, "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def samples(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_encoding_is_the_librarys(library):
    vocab = bpe.vocabulary(PATH)
    for text in [*samples(1, 3000), *filter(None, EDGES)]:
        want = library.encode(text, add_special_tokens=False).ids
        assert vocab.encode(text) == want, text
        assert vocab.decode(want) == library.decode(want, skip_special_tokens=False)


def test_forced_boundaries():
    vocab = bpe.vocabulary(PATH)
    raw = "thezq\xffqx the".encode()
    assert b"".join(vocab.fragments(raw)) == raw
    for left, right in zip(vocab.fragments(raw), vocab.fragments(raw)[1:]):
        assert not any(left[-1:] + right[:1] in token for token in vocab.ids)
    word = b"abab" * 100  # longer than the short loop
    short = [vocab.single[b] for b in word]
    assert b"".join(vocab.bytes_of[i] for i in vocab.merge_long(list(short))) == word


def test_every_prefix(library):
    table = prefix_counts.counter(PATH)
    rng = random.Random(5)
    for text in samples(2, 500):
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]
        assert table.every_prefix(text).tolist() == want, text
        limit = rng.randint(0, 8)
        fits = max((k for k in range(len(text) + 1) if k == 0 or want[k - 1] <= limit), default=0)
        assert table.budget(text, limit) == (want[-1] if want else 0, fits)


def test_words_of_different_parts_are_counted_once(library, monkeypatch):
    table = prefix_counts.PrefixCounter(PATH)
    counted = []
    word = table.word
    monkeypatch.setattr(table, "word", lambda raw: counted.append(raw) or word(raw))
    text = "Zebra zebra, zebra. (zebra) zébra zébra! " * 3
    assert table.budget(text, 1000)[0] == len(library.encode(text, add_special_tokens=False).ids)
    assert len(counted) == len(set(counted))
    monkeypatch.setattr(prefix_counts, "KNOWN_WORDS", 2)
    assert prefix_counts.PrefixCounter(PATH).every_prefix(text).tolist() == table.every_prefix(text).tolist()


def edge_table(spark, **extra):
    rows = [(k if k % 3 else None, t, "clash", 1.0) for k, t in enumerate(EDGES + EDGES[3:5])]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score double")


def test_tokens_of_edge_rows(spark, library):
    docs = edge_table(spark)
    got = bpe.round_trip(docs, PATH).collect()
    assert len(got) == docs.count()
    want = Counter()
    for t in EDGES + EDGES[3:5]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    counted = prefix_counts.token_budget(docs, PATH, 512).collect()
    assert Counter(r.n_tokens for r in counted) == Counter(n for n, _, _ in want.elements())
    assert all(r.over_limit == (r.n_tokens > 512) for r in counted)
    ids = bpe.encode(docs, PATH, keep_columns=("doc_id",))
    back = bpe.decode(ids, PATH, keep_columns=("doc_id",)).collect()
    assert Counter(r.text for r in back) == Counter(t or "" for t in EDGES + EDGES[3:5])
    arrays = prefix_counts.prefix_counts(docs.limit(5), PATH, keep_columns=("text",)).collect()
    assert all(len(r.prefix_tokens) == len(r.text or "") for r in arrays)
    for f in (bpe.round_trip(docs.limit(0), PATH), prefix_counts.token_budget(docs.limit(0), PATH, 1)):
        assert f.count() == 0


def test_repetition(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4)))
    texts = EDGES + [" ".join(word() for _ in range(n)) for n in (5, 60, 200, 700)]
    texts += ["\n".join(rng.choice(["one line here", "two", "", " "]) for _ in range(60)), "ab#$ " * 3, "日本語のテキスト" * 40]
    block = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(90))
    texts += [block + " " + block, block]
    got = repetition.measure(texts, repetition.RepetitionRules())
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {i + j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\v\f\r")]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        assert tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got["base_failed"][k] == (len(words) < 50 or 100 * len(again) > 50 * len(words))
    assert got["covered_fraction"][len(texts) - 2] == 1.0 and got["covered_fraction"][len(texts) - 1] == 0.0
    assert got["longest_fraction"][len(texts) - 2] == pytest.approx(0.5)
    # the repeated characters of a long word are found though it is one word
    assert got["covered_fraction"][5] == 1.0
    docs = edge_table(spark)
    assert repetition.repetition(docs).count() == docs.count()
    assert repetition.repetition(docs.limit(0)).count() == 0


def test_repeats_by_brute_force():
    rng = np.random.default_rng(2)
    ids, owner = rng.integers(0, 3, 200), np.sort(rng.integers(0, 4, 200))
    got = repetition.repeats(ids, owner)
    for i in range(200):
        best = 0
        for j in range(200):
            if i != j and owner[i] == owner[j]:
                k = 0
                while max(i, j) + k < 200 and owner[i + k] == owner[i] == owner[j + k] and ids[i + k] == ids[j + k]:
                    k += 1
                best = max(best, k)
        assert got[i] == best


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_language(spark):
    rng = random.Random(3)
    words = {"xx": ["lorem", "dolor", "amet", "sit"], "yy": ["kva", "czi", "pruk", "zlom"]}
    rows = [(k, prose(rng, words[lang], rng.randint(8, 300)), lang) for k in range(120) for lang in ("xx", "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs.where("doc_id < 80"))
    found = language.identify(docs.where("doc_id >= 80"), model, keep_columns=("doc_id", "lang")).collect()
    assert np.mean([r.nearest == r.lang for r in found]) > 0.98
    assert all(0 <= r.score <= 1 for r in found)
    edges = language.identify(edge_table(spark), model).collect()
    assert sum(r.nearest == "und" for r in edges) == 3
    assert language.identify(docs.limit(0), model).count() == 0
    nothing = language.train(docs.limit(0))
    assert {r.nearest for r in language.identify(docs.limit(3), nothing).collect()} == {"und"}


def test_toxicity(spark):
    rng = random.Random(4)
    syllables = ["ta", "ri", "mon", "el", "su", "ker", "po", "in"]
    plain = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    rows = []
    for k in range(900):
        text = prose(rng, plain, rng.randint(40, 120)).split()
        bad = k % 5 == 0
        for _ in range(3 if bad else 0):
            text[rng.randrange(len(text))] = rng.choice(["wretched", "vermin", "buffoon"])
        rows.append((k, " ".join(text), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.where("doc_id < 600"))
    got = toxicity.score(docs.where("doc_id >= 600"), model, keep_columns=("toxic",)).collect()
    assert np.mean([(r.score >= 0.7) == bool(r.toxic) for r in got]) > 0.9
    edges = toxicity.score(edge_table(spark).drop("score"), model).collect()
    assert all(0 <= r.score <= 1 for r in edges)
    assert toxicity.score(docs.limit(0), model).count() == 0
    alike = toxicity.score(docs.limit(3), toxicity.train(docs.limit(0))).collect()
    assert {r.score for r in alike} == {0.5}


def test_warc(spark, tmp_path):
    bodies = [None, "", "<p>a</p>", "<p>a</p>", "<p>b é</p>", "x" * 70_000, "", "<p>a</p>"]
    rows = [(k if k != 7 else None, f"http://h/{k} ?q%" if k % 4 else None, b, "z") for k, b in enumerate(bodies)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    archives = warc.write(pages)
    files = archives.collect()
    got = {(r.record_id, r.payload_digest): r for r in warc.read(archives).collect()}
    raws = [(b or "").encode() for b in bodies]
    for (k, url, _, _), raw in zip(rows, raws):
        r = got[k, base64.b32encode(hashlib.sha1(raw).digest()).decode()]
        leader = max(i for i, other in enumerate(raws) if other == raw and i != 7)
        assert (r.payload_bytes, r.problem, r.url) == (len(raw), None, url)
        assert (r.record_type, r.refers_to) == (("response", None) if k == leader else ("revisit", leader))
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == raw
    small = warc.read(warc.write(pages, min_revisit_bytes=5)).where("record_type = 'revisit'").collect()
    assert {r.record_id for r in small} == {2, None}
    assert warc.through_archives(pages.limit(0)).count() == 0
    # files, and archives that are damaged
    warc.export(archives, f"file://{tmp_path}/out").collect()
    assert warc.read(warc.files(spark, f"{tmp_path}/out")).count() == len(rows)
    content = bytes(files[0].content)
    broken = spark.createDataFrame([(content[:-5],), (b"",), (None,)], "content binary")
    assert [r.problem for r in warc.read(broken).collect()][-1] == "frame"
    record = warc.record_bytes(1, "u", b"abc")
    assert warc.parse(record)["problem"] is None
    assert warc.parse(record[:-1])["problem"] == "length"
    assert warc.parse(record.replace(b"abc", b"abd"))["problem"] == "block digest"
    assert warc.parse(b"nothing")["problem"] == "header"


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>site</header><nav><ul><li><a href="/x">menu</a></ul></nav><!-- c --><div class="ad">buy</div>
<div class="cookie-notice">cookies</div><div class="%s"><h1>Head &amp; more</h1><p><b>First<br>line &eacute;.<p>Second
  text</p><form>ask</form><aside class="sidebar">side</aside><p>Third longer paragraph of text, here.</div>
<div class="comments"><p>reader comment that is longer than the article itself, by far, to be sure of it, and more</p></div>
<footer>&copy; me</footer></body></html>"""


def test_html(spark):
    article = "Head & more\n\nFirst line é.\n\nSecond text\n\nThird longer paragraph of text, here."
    rows = [(k, f"http://a.example/{k}", PAGE % f"post item{k}") for k in range(6)]
    rows += [(6, "http://a.example/6", None), (7, None, ""), (8, "http://[bad", "plain words <p>and a block"), (9, "http://b/", "<nav>only</nav>"), (None, "http://a.example/0", PAGE % "post item0")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string").repartition(3)
    got = {r.page_id: r for r in html_consensus.main_text(pages).collect()}
    assert len(got) == len(rows)
    for k in (0, 1, 2, 3, 4, 5, None):
        assert got[k].text == article and got[k].n_chars == len(article)
        assert got[k].path == "html>body>div.item#.post"
    assert [got[k].text for k in (6, 7, 8, 9)] == ["", "", "plain words\n\nand a block", ""]
    assert html_consensus.main_text(pages.limit(0)).count() == 0


def test_decontamination(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    filler = lambda: prose(rng, words, 40)
    question = "Yesterday morning Alice bought 12 apples for 3 dollars and gave Robert 12 of them after walking 5 km home"
    renamed = question.replace("12", "45").replace("Alice", "Maria").replace("5 km", "7 miles")
    wrong = question.replace("Robert 12 of", "Robert 13 of")
    items = [(1, question), (2, prose(rng, words, 30)), (3, None), (4, ""), (5, "too short"), (None, prose(rng, words, 12))]
    texts = [filler() + " " + question + " " + filler(), filler() + " " + renamed + ". " + filler(), filler() + " " + wrong + " " + filler(), filler(), None, "", items[1][1].upper() + "!!", items[5][1], filler() + " " + prose(rng, items[1][1].split()[:8], 8)]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts + texts[:1])], "doc_id long, text string, item_id string, place int").repartition(2)
    bench = spark.createDataFrame([(*i, "y") for i in items], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (2, 1), (9, 1), (6, 2), (7, None)}
    assert got[0, 1].contaminated and got[0, 1].changed_slots == 0 and got[0, 1].n_slots >= 5
    assert got[1, 1].contaminated and got[1, 1].changed_slots >= 3
    assert not got[2, 1].contaminated
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.schema == docs.schema and {r.doc_id for r in left.collect()} == {2, 3, 4, 5, 8}
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_windows_are_hashed_in_rows(spark):
    texts = ["", "one two", "one two three four five", "In 1999 Anna paid 20 dollars for 3 Red apples."]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    table = decontaminate.templates(docs, ["id"])
    got = decontaminate._windows(table, ["id"], 5)
    # a hash per window inside a lambda took most of op3's time
    assert not re.search(r"lambdafunction\([^\n]*xxhash64\(slice\(", got._jdf.queryExecution().optimizedPlan().toString())
    words = {r.id: (r.canon, r.cores) for r in table.collect()}
    wanted = {(i, k) for i, (canon, _) in words.items() for k in range(len(canon) - 4)}
    assert {(r.id, r.place) for r in got.collect()} == wanted and len(wanted) == 7
    same = spark.createDataFrame([(i, k, words[i][0][k : k + 5], [c.lower() for c in words[i][1][k : k + 5]]) for i, k in wanted], "id long, place int, a array<string>, b array<string>")
    each = lambda c: F.xxhash64(F.transform(c, lambda w: F.xxhash64(w)))
    assert same.join(got, ["id", "place"]).where((each("a") == F.col("w1")) & (each("b") == F.col("w3"))).count() == 7


def pairs(spark, texts, items, settings=decontaminate.TemplateSettings()):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench, settings).collect()}


def test_names_at_sentence_starts_and_case(spark):
    short = "Tom has 5 cats. Tom buys 3 dogs. Tom sells 2 birds."
    names = "Yesterday morning Alice saw Robert near Maria while Peter and Alice gave Robert some bread for Maria today"
    texts = ["So it is. " + short.replace("Tom", "Bob").replace("5", "9"), names.upper(), "so " + names.lower() + " end", "Bob has 5 cats. The rest is something else entirely, as it should be."]
    got = pairs(spark, texts, [short, names])
    assert set(got) == {(0, 0), (1, 1), (2, 1)} and all(r.contaminated for r in got.values())
    assert got[0, 0].changed_slots >= 3


def test_short_items_and_few_words(spark):
    items = ["What is 12 * 7?", "Lisbon", "5 km 3 kg 7 cm 9 mm 4 ft 8 yd", "The red house has windows 12 3 4 5 6 7 8 9"]
    texts = ["well, what is 12 * 7? he asked", "I was in Lisbon once", "lisbon!", "list 5 km 3 kg 7 cm 9 mm 4 ft 8 yd", "What is 13 * 7?", "Now the red house has windows and much more", items[3]]
    got = pairs(spark, texts, items)
    assert {k for k, r in got.items() if r.contaminated} - {(5, 3)} == {(0, 0), (2, 1), (3, 2), (6, 3)}
    # one window of five words is not enough where a minimum of words is asked for
    strict = pairs(spark, texts, items, decontaminate.TemplateSettings(template_words=8, min_share=0.25))
    assert (5, 3) not in strict and {(0, 0), (2, 1), (3, 2), (6, 3)} <= set(strict)


def test_share_of_consistent_slots(spark):
    item = "He bought 12 red pens and 3 blue pens then gave 4 green pens and 8 black pens to her at noon"
    merged = item.replace("12", "5").replace(" 3 ", " 5 ")
    mixed = item.replace("12", "4").replace("4 green", "6 green")
    wild = "He bought 12 red pens and 12 blue pens then gave 12 green pens and 12 black pens to her at noon"
    settings = decontaminate.TemplateSettings(min_consistent=0.75)
    got = pairs(spark, [merged, mixed, wild], [item, wild], settings)
    assert got[0, 0].contaminated and not got[0, 0].consistent and got[1, 0].contaminated
    # different values throughout for one and the same
    assert not got[1, 1].contaminated
    assert not pairs(spark, [merged], [item])[0, 0].contaminated


def test_html_whole_articles():
    p = "<p>" + "A sentence of an article that has some length. " * 6 + "</p>"
    split = f"<html><body><nav>menu</nav><main><h1>Title</h1><article>{p * 3}</article><section>{p.replace('article', 'appendix') * 2}</section></main></body></html>"
    got, path = html_consensus.extract(split, [html_consensus.vote(split)])
    assert path == "html>body>main" and got.startswith("Title") and got.count("appendix") == 12
    intro = f"<html><body><div id=content><h1><a href=/>Title</a></h1><p>Intro text.</p><div class=body>{p * 4}</div></div><p><a href=/x>more</a> | <a href=/y>links</a></p></body></html>"
    got, path = html_consensus.extract(intro, [])
    assert got.startswith("Title\n\nIntro text.") and "links" not in got
    story = f"<html><body><div class=post><p>Teaser.</p></div><div class=story>{p * 3}</div></body></html>"
    got, path = html_consensus.extract(story, ["html>body>div.post", "html>body>div.story"])
    assert path == "html>body>div.story" and got.count("sentence") == 18


def test_html_ambiguous_classes():
    names = ['div class="entry-header"', 'section id="discussion"', 'section id="related-work"', 'div class="social-science"', 'div class="search-methods"', 'h1 class="page-header"']
    parts = "".join(f"<{n}>Part {k} of the content.</{n.split()[0]}>" for k, n in enumerate(names))
    links = '<div class="related-posts"><a href="/a">Another post</a> <a href="/b">And one more</a></div>'
    for tag in ("article", "div"):
        got, _ = html_consensus.extract(f'<html><body><div class="site-header">Site</div><{tag}>{parts}{links}<div class="ad">buy</div></{tag}><div class="comments">reader</div></body></html>', [])
        assert got == "\n\n".join(f"Part {k} of the content." for k in range(6))


def test_language_sample_is_bounded(spark):
    long = "a " * 100_000 + "middle " * 20 + "b " * 100_000
    docs = spark.createDataFrame([(long, "xx"), ("short text", "yy")], "text string, lang string")
    got = {r.label: r.text for r in language.bounded_sample(docs, "lang", "text", 64, 1000).collect()}
    assert len(got["xx"]) == 1000 and "middle" in got["xx"] and got["yy"] == "short text"
    assert b"middle" in language.train(docs).contents["xx"]


def test_letters_are_letters(spark):
    docs = spark.createDataFrame([("una casa blanca y grande " * 20, "es"), ("the white house is large " * 20, "en")], "text string, lang string")
    model = language.train(docs)
    rows = spark.createDataFrame([(0, "½ ² Ⅷ ①"), (1, "12 _ 3"), (2, "the house ½")], "doc_id long, text string")
    got = {r.doc_id: r.nearest for r in language.identify(rows, model).collect()}
    assert got == {0: "und", 1: "und", 2: "en"}


def test_html_wrappers_keep_the_article():
    article = "".join(f"<p>{'word ' * 30}{k}.</p>" for k in range(6))
    comments = f'<div class="comments"><article class="comment"><p>{"reader says " * 300}</p></article></div>'
    names = "main-content has-sidebar|post share-buttons-enabled|comments-open|ad-free|elementor-widget-theme-post-content|content no-sidebar|elementor-widget-container|market-share|menu-recipe|ad-hoc|sidebar-layout"
    for name in names.split("|"):
        page = f'<body><nav>menu</nav><article><h1>Title</h1><div class="{name}">{article}</div></article>{comments}</body>'
        got, _ = html_consensus.extract(page, [])
        assert got.startswith("Title\n\nword") and got.count("word") == 180 and "reader" not in got, name
        got, _ = html_consensus.extract(f'<body><div class="{name}"><h1>Title</h1>{article}</div><div class="sidebar">side</div>{comments}</body>', [])
        assert got.count("word") == 180 and "reader" not in got and "side" not in got, name


def test_html_hidden_and_inline_adverts():
    p = "<p>" + "A sentence that stays. " * 10
    page = f'<body><article>{p}<span hidden>no</span><span class="ad">buy</span><b style="display: none">gone</b><i>yes</i></p><div style="display:none">{p}</div></article></body>'
    got, _ = html_consensus.extract(page, [])
    assert got == "A sentence that stays. " * 10 + "yes"


@pytest.mark.parametrize("page", ["<p>x<b>" * 16000, "<div>" * 8000 + "text", "<div><p>t" * 4000, "<ul><li>x" * 5000 + "<a>" * 3000])
def test_html_deep_pages(page):
    begun = time.time()
    vote = html_consensus.vote(page)
    got, path = html_consensus.extract(page, [vote] if vote else [])
    assert got and time.time() - begun < 20


def test_html_equal_votes(spark):
    a, b = "<body><div class=x><p>{}</p></div></body>", "<body><div class=y><p>{}</p></div></body>"
    pages = [(k, "http://h/", (a if k % 2 else b).format("text " * 20 + str(k))) for k in range(10)]
    got = html_consensus.host_paths(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert [r.paths for r in got] == [["body>div.x", "body>div.y"]]
