"""Text operators: tokenizer against the library, mixing against brute force, pages, residue and abuse on small cases."""

import os
import random

import pytest

pytest.importorskip("placewright.llm")

from placewright.llm import abuse, blocks, mainbody, mixing, residue, tokenizer  # noqa: E402
from placewright.llm.abuse_seeds import training_sentences  # noqa: E402

VOCAB = "/opt/tokenizers"
needs_vocab = pytest.mark.skipif(not os.path.exists(f"{VOCAB}/byte_bpe_50k.json"), reason="no vocabulary files")


@pytest.fixture(scope="module")
def automaton():
    return tokenizer.compile_automaton(f"{VOCAB}/byte_bpe_50k.json")


@needs_vocab
def test_ids_equal_the_library(automaton):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(f"{VOCAB}/byte_bpe_50k.json")
    lib.encode_special_tokens = True
    rnd = random.Random(1)
    alphabet = "aAbe  \n\t't lréß日本語0123!?#<|endoftext|>😀 ​﻿\x00\x1c�"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 80))) for _ in range(600)]
    texts += ["a" * 3000, " " * 2001, "日本" * 900, "<|endoftext|> x", "I'll we've don't\r\n\r\n  x", "𝓗𝓮𝓵𝓵𝓸 ÃƒÂ©"]
    for t in texts:
        ids = automaton.encode(t)
        assert ids == lib.encode(t, add_special_tokens=False).ids
        assert automaton.decode(ids) == t


@needs_vocab
def test_encode_column(spark):
    df = spark.createDataFrame([(1, "hi there"), (2, ""), (3, None), (4, "hi there")], "doc_id int, text string")
    rows = {r.doc_id: list(r.ids) for r in tokenizer.encode_texts(df).collect()}
    assert rows[2] == [] and rows[3] == [] and rows[1] == rows[4] == [5303, 612]
    back = tokenizer.decode_ids(tokenizer.encode_texts(df), out="again").where("doc_id = 1").first()
    assert back.again == "hi there"
    assert {r.doc_id: r.tokens for r in tokenizer.count_tokens(df).collect()} == {1: 2, 2: 0, 3: 0, 4: 2}
    assert tokenizer.encode_texts(spark.createDataFrame([], df.schema)).count() == 0


def test_automaton_by_hand():
    # merges: ab -> 2, ab+a -> 3; "abab" is [2, 2]: after 3 no state takes "b"
    a = tokenizer.Automaton([(97, 0), (98, 1)], [(0, 1, 2), (2, 0, 3)])
    assert a.encode_word(b"aba") == (3,) and a.encode_word(b"abab") == (2, 2) and a.encode_word(b"abaab") == (3, 2)
    assert not a.allowed(0, 1) and a.allowed(1, 0)


def _mix(spark, docs, targets, slices=4, total=None):
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    sized = mixing.sized_documents(d, t, slices=slices)
    plan = mixing.budgets(sized, t, total)
    return sized.collect(), {r.source: r for r in plan.collect()}, mixing.mix(sized, plan).collect(), {r.source: r for r in mixing.shares(mixing.mix(sized, plan), plan).collect()}


@needs_vocab
@pytest.mark.parametrize("slices", [1, 4, 64])
def test_mix_against_brute_force(spark, slices):
    rnd = random.Random(2)
    docs = [(i, rnd.choice(["a", "a", "a", "b", "c", None, "other"]), "word " * rnd.randint(0, 9)) for i in range(150)] + [(900, "a", None), (None, "a", "x")]
    targets = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 5)]
    sized, plan, mixed, report = _mix(spark, docs, targets, slices)
    caps = {s: plan[s].available * plan[s].max_repeats for s in "abc"}
    scale = min(caps[s] / plan[s].target_share for s in "abc")
    copies = {r.doc_id: r.copies for r in mixed}
    for s in "abc":
        budget = round(plan[s].target_share * scale)
        assert plan[s].budget == budget and plan["none"].budget == 0
        epochs, rest = divmod(budget, plan[s].available)
        upto = 0
        for r in sorted((r for r in sized if r.source == s), key=lambda r: (r.key, r.doc_id)):
            upto += r.tokens
            want = epochs + (2 * upto - r.tokens <= 2 * rest and rest > 0)
            assert copies.get(r.doc_id, 0) == want and want <= plan[s].max_repeats
        assert abs(report[s].mixed_tokens - budget) <= max(r.tokens for r in sized if r.source == s)
    assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9 and report["none"].mixed_tokens == 0


@needs_vocab
def test_mix_with_total_and_empty(spark):
    docs = [(i, "a", "word word") for i in range(10)] + [(100 + i, "b", "word word") for i in range(2)]
    _, plan, _, _ = _mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], total=18)
    assert plan["b"].budget == 8 and plan["a"].budget == 10
    _, plan, mixed, report = _mix(spark, [], [("a", 1.0, 1)])
    assert plan["a"].budget == 0 and mixed == [] and report["a"].actual_share == 0


NAV = "<nav><ul><li><a href=/a>About</a></li><li><a href=/c>Contact</a></li></ul></nav>"
FOOT = "<footer><p>© 2000 Shop. All rights reserved.</p></footer>"


def _page(body, extra=""):
    return f"<html><head><title>t</title><style>p{{}}</style></head><body>{NAV}{extra}<main><h1>Head</h1>{body}</main>{FOOT}</body></html>"


def test_blocks():
    got = [(b.text, b.tag) for b in blocks.blocks("<p>A <b>b</b>&nbsp;&amp;<br>c<p>d<ul><li>e<li>f</ul><script>x</script><!-- y --><table><tr><td>g<td>h</table>tail")]
    assert got == [("A b &", "p"), ("c", "p"), ("d", "p"), ("e", "li"), ("f", "li"), ("g", "td"), ("h", "td"), ("tail", "body")]
    assert blocks.blocks("") == [] and blocks.blocks("<<<>>></p></div>&#0;<b") is not None


def test_longest_common_subsequence(monkeypatch):
    rnd = random.Random(4)
    for _ in range(200):
        a, b = [rnd.randint(0, 5) for _ in range(rnd.randint(0, 9))], [rnd.randint(0, 5) for _ in range(rnd.randint(0, 9))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        monkeypatch.setattr(mainbody, "CELLS", rnd.choice([400_000_000, 8]))
        at = sorted(mainbody.shared_lines(a, b))
        assert len(at) == table[-1][-1]
        it = iter(b)
        assert all(any(a[i] == y for y in it) for i in at)


def test_main_bodies(spark):
    side = "<div class='q1'><h3>Tag cloud</h3><ul><li><a href=/p0>some cut off li</a></li></ul></div>"
    rows = [
        (1, "https://a.example.com/", _page("<p>First text.</p><p>Same hours.</p>") + side),
        (2, "https://a.example.com/x", _page("<p>Second text.</p><p>Same hours.</p>", "<div id=cookie-banner>We use cookies</div>") + side),
        (3, "https://a.example.com/x", _page("<p>Second text.</p><p>Same hours.</p>", "<div id=cookie-banner>We use cookies</div>") + side),
        (4, "https://b.example.com/", "<h1>Not Found</h1><p>Gone.</p>"), (5, None, "<p>alone</p>"), (6, "u", None), (7, "u", "  "),
    ]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("page_id", "url", "CAST(NULL AS STRING) AS final_url", "html", "'x' AS body", "1 AS h")
    for pieces in (None, 1, 3):
        got = {}
        for r in mainbody.main_bodies(df, pieces=pieces).collect():
            got.setdefault(r.page_id, set()).add(r.paragraph)
        assert got == {1: {"Head", "First text.", "Same hours."}, 2: {"Head", "Second text.", "Same hours."}, 3: {"Head", "Second text.", "Same hours."}, 4: {"Not Found", "Gone."}, 5: {"alone"}}
    assert mainbody.main_bodies(df.where("false")).count() == 0


def test_differencing_decides_the_main_body():
    def page(n):
        frame = "<p>Bonded and insured.</p><p>Proudly powered by SiteKettle</p>"
        return mainbody.layout(f"<body><nav>Home Shop</nav><div><div>x</div><h1>Head {'abc'[n]}</h1><p>Text {'abc'[n]}.</p><p>Same hours.</p><p>More {'abc'[n]}.</p>{frame}</div><hr><section><div>y</div><p>Outside {'abc'[n]}.</p>{frame}</section></body>")

    pages = [page(n) for n in range(3)]
    lines = [[mainbody.mask(p[0]) for p in ps] for ps in pages]
    assert mainbody.main_body(pages[1], [lines[0], lines[2]]) == ["Head b", "Text b.", "Same hours.", "More b.", "Outside b."]
    # all text of the stretch with the title is shared: the body is elsewhere
    titled = [mainbody.layout(f"<body><nav>Home Shop</nav><div><div>x</div><h1>Our shop</h1><p>Bonded and insured.</p></div><section><div>y</div><p>Outside {c}.</p></section></body>") for c in "ab"]
    assert mainbody.main_body(titled[0], [[mainbody.mask(p[0]) for p in titled[1]]]) == ["Outside a."]


@pytest.fixture(scope="module")
def residue_model():
    rnd = random.Random(6)
    words = "our crew checks every roof and oven before noon the shop opens early and ask for a written estimate with your parts in the box we sand paint and clean on weekdays".split()
    return residue.Residue([" ".join(rnd.choice(words) for _ in range(14)) + "." for _ in range(400)])


@pytest.mark.parametrize(
    "body, found",
    [
        ("<p>Our crew checks every roof before noon and the shop opens early on weekdays.</p>", False),
        ("<p>Our crew checks {{city}} before noon and the shop opens early.</p>", True),
        ("<p>Call [Your Company Name] before noon and ask for a written estimate.</p>", True),
        ("<p>Closed [most] weekdays, our crew checks every oven.</p>", False),
        ("<p>Lorem ipsum dolor sit amet consectetur adipiscing elit.</p><p>Our crew checks every roof.</p>", True),
        ("<p>The page you were looking for is not here. It may have been moved or deleted.</p>", True),
        ("<p>You need to enable JavaScript to run this app.</p>", True),
        ("<noscript>Please enable JavaScript.</noscript><script>'{{x}}'</script><!-- {{y}} --><p>Our crew checks every roof before noon and the shop opens early.</p>", False),
    ],
)
def test_residue(residue_model, body, found):
    left, cover = residue_model.page(f"<html><body>{body}</body></html>")
    assert (left or cover >= residue.COVERAGE) is found


def test_residue_table(spark, residue_model):
    df = spark.createDataFrame([(1, "<p>Lorem ipsum dolor sit amet elit.</p>"), (2, None), (3, " "), (4, "<p>Our crew checks every roof.</p>"), (5, "<div></div>")], "page_id int, html string")
    scored = residue.score_pages(df, residue_model)
    assert sorted(r.page_id for r in scored.collect()) == [1, 4, 5]
    assert [r.page_id for r in residue.residue_pages(scored).collect()] == [1]


def test_residue_learns_from_every_page(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("aeioubdklmnrst") for _ in range(6))
    rows = [(i, None if i % 2 else 200, [" ".join(word() for _ in range(9)) + ".", "We repair roofs."] * (1 + 5 * (i % 7 == 0))) for i in range(1600)]
    rows += [(2000 + i, 404, [f"The page {word()} was not found on this server. It may have been moved or deleted."]) for i in range(600)]
    rows += [(3000, 200, ["Our crew checks every roof before noon. " * 600 + "Quartz vexed jumbling zephyrs."]), (3001, 200, ["Lorem ipsum dolor sit amet elit. " * 20]), (3002, 200, [])]
    found = residue.fit(spark.createDataFrame(rows, "page_id int, status int, body array<string>"))

    bodies = [b for _, _, b in rows if b]
    seeds = residue.Residue([])
    long = dict.fromkeys(t for _, status, b in rows if (status or 0) < 400 and sum(map(len, b)) >= residue.LONG for t in b)
    model = residue.Residue([t for t in long if seeds.means([residue.fold(t)])[0, residue.FILLER] < residue.CLEARLY and not seeds.holds(t)])
    for _ in range(2):
        judged = model.pages([(b, b) for b in bodies])
        notices = dict.fromkeys(t for b, (left, cover) in zip(bodies, judged) if not left and cover >= 0.5 for t in b)
        natural = dict.fromkeys(t for b, (left, cover) in zip(bodies, judged) if not left and cover < residue.COVERAGE / 2 for t in b)
        model = residue.Residue(list(natural), list(notices))
    assert len(notices) > 500 and len(natural) > 1500
    assert all((a == b).all() for a, b in zip(found.keys, model.keys)) and all((a == b).all() for a, b in zip(found.ratios, model.ratios))


def test_residue_bounds_hold_for_large_tables():
    rnd = random.Random(9)
    words = "our crew checks every roof and oven before noon the shop opens early and ask for a written estimate with your parts in the box".split()
    texts = [residue.fold(" ".join(rnd.choice(words) for _ in range(12)) + ".") for _ in range(3000)] + ["quigley vandermeer photographs zinnias."]
    many = [(keys, ends, times * 500) for keys, ends, times in residue.counted(texts)]
    model = residue.Residue([], learnt={residue.NATURAL: many})
    found = model.blocks(["Lorem ipsum dolor sit amet consectetur.", "Quigley Vandermeer photographs zinnias.", "Our crew checks Quigley's oven before noon.", "Call {{city}} before noon."])
    assert [left for left, _ in found] == [True, False, False, True]


@pytest.fixture(scope="module")
def weights():
    return abuse.learn(["Our crew is punctual and careful. Prices start at $20.", "The roof was rebuilt in 1990."], seeds=6000)


def test_abuse_held_out(weights):
    unseen = training_sentences(1500, seed=99)
    right = sum((abuse.score(weights, abuse.plain(s)) >= abuse.THRESHOLD) == bool(y) for s, y in unseen)
    assert right / len(unseen) > 0.95


@pytest.mark.parametrize(
    "text, bad",
    [
        ("The oven is new. You w0rthl3ss lowlife, go r0t!", True), ("You ugly l e e c h, go r-o-t.", True), ("You wоrthlеss lоser, go rot.", True), ("You rotten looooser, drop dead", True), ("You m*ron, burn in hell.", True),
        ("Harassment policy: threats, insults or hate speech toward our crew end the appointment.", False), ("We kill cockroaches, rats and other vermin.", False), ("", False), ("123 !!!", False),
    ],
)
def test_abuse_disguises(weights, text, bad):
    best = max((abuse.score(weights, p) for p in abuse.passages(text)), default=0.0)
    assert (best >= abuse.THRESHOLD) is bad


def test_abuse_tables(spark, weights):
    df = spark.createDataFrame([(1, "a", "You worthless loser, go rot."), (2, "a", None), (3, None, "Fine work."), (4, "a", "word " * 5000 + ". You worthless loser, go rot.")], "doc_id int, source string, text string")
    scored = abuse.score_documents(df, weights)
    assert sorted(r.doc_id for r in abuse.flagged(scored).collect()) == [1, 4]
    assert {r.source: (r.documents, r.flagged) for r in abuse.source_rates(scored).collect()} == {"a": (3, 2), None: (1, 0)}


def test_abuse_written_by_hand(weights):
    """Sentences in no pattern of the seeds."""
    cases = ["Honestly, the cook is a miserable lowlife and a liar.", "I swear I will break his jaw if he calls again.", "People of that religion are filth and should be deported.", "Hope the manager dies alone.", "Hot naked girls on cam for you, join now.", "Verpiss dich, du dreckiges Schwein.", "Ojalá te mueras, asqueroso."]
    fine = ["The plumber came on Tuesday and fixed the leak under the sink.", "Our nurse talks about safe sex with teenagers.", "The rat trap behind the oven works.", "We welcome refugees to the sewing class.", "The soup was cold and the waiter forgot us.", "This bakery is killing it with those rolls.", "Die Werkstatt hat am Samstag geschlossen."]
    worst = lambda t: max(abuse.score(weights, p) for p in abuse.passages(t))
    right = sum(worst(t) >= abuse.THRESHOLD for t in cases) + sum(worst(t) < abuse.THRESHOLD for t in fine)
    assert right >= 12


@needs_vocab
def test_texts_are_tokenized_once(spark):
    d = spark.createDataFrame([(1, "a", "x y")], "doc_id bigint, source string, text string")
    plan = tokenizer.count_tokens(d).where("tokens > 0").select("doc_id", "tokens")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_neighbours_decide_what_is_frame():
    """Without neighbours the unmarked frame stays in the body: the alignment takes it away, not the markup."""
    def page(c):
        return mainbody.layout(f"<body><div><div>x</div><p>Family owned since 1990.</p><p>Visit our other shop downtown.</p></div><hr><div><div>y</div><h1>Title {c}</h1><p>Story {c} told at length.</p></div></body>")

    lines = [mainbody.mask(p[0]) for p in page("b")]
    alone, with_other = mainbody.main_body(page("a"), []), mainbody.main_body(page("a"), [lines])
    assert "Story a told at length." in alone and with_other == ["Title a", "Story a told at length."]
    titleless = mainbody.layout("<body><div><div>x</div><p>Family owned since 1990, and proud of the old oven.</p></div><hr><div><div>y</div><p>Story a.</p></div></body>")
    other = [mainbody.mask(t) for t in ("x", "Family owned since 1990, and proud of the old oven.", "y", "Story b.")]
    assert mainbody.main_body(titleless, []) != mainbody.main_body(titleless, [other]) == ["Story a."]
