import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("leafmill.llm")
from leafmill.llm import body, bpe, furniture_texts, labelled, main_body, mixing, near, pieces, quality, residue, residue_texts, site_lines, tokens  # noqa: E402
from leafmill.llm.kernel import Block, blocks  # noqa: E402

VOCAB = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PAGE = "Skip to content\n\n[Home](/home) [Docs](/docs) [Login](/login)\n\nWe use cookies to keep you signed in and to measure how the Acme site is used.\nAccept all\n\n# Configure salder\n\nEach batch copies its own tables, so a small key never blocks another one. You can open the folder with salder, but the files stay locked.\n\n```\n{\n}\n```\n\nShare this article with your team: Copy link | Mail | Chat\n\nWhen a server is slow, the parser drops all rows and keeps the connection open.\n\nRelated guides\n* Limits of velmor keys\n* Working with gosbel rows\n\n© 2024 Acme Ltd. All rights reserved.\nBack to top"
FURNITURE = [1, 3, 5, 6, 17, 21, 22, 23, 25, 26]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, content string, url string, line_no int")


def sentences(n, seed):
    r = np.random.default_rng(seed)
    w = [f"w{i}" for i in range(400)]
    return " ".join(r.choice(w, n))


# --- problem 1


def test_held_out_pages():
    made = labelled.pages(150, seed=991)
    x = body.Lines(Block(["\n".join(t for t, _ in p) for p in made]))
    y = np.array([v for p in made for _, v in p if v >= 0])
    got = body.model().body(x)
    assert (got == (y == 1)).mean() > 0.98


def _share(model, made):
    """Share of the lines with the right label, and of the furniture that is found."""
    x = body.Lines(Block(["\n".join(t for t, _ in p) for p in made]))
    own = np.array([v == 1 for p in made for _, v in p if v >= 0])
    got = model.body(x)
    return (got == own).mean(), (~got & ~own).sum() / (~own).sum()


@pytest.mark.parametrize("lang, least", [("en", 0.8), ("de", 0.88), ("fr", 0.88), ("es", 0.9), ("pt", 0.9), ("ja", 0.68)])
def test_pages_of_a_language_left_out_of_the_fit(lang, least):
    m = body.model(labelled.PAGES, tuple(x for x in furniture_texts.LANGUAGES if x != lang))
    right, found = _share(m, labelled.pages(150, 77, [lang]))
    print(f"{lang}: {right:.3f} of the lines right, {found:.3f} of the furniture found")
    assert found > least and right > least


@pytest.mark.parametrize("group, least", [("controls", 0.45), ("menu", 0.7), ("consent", 0.05), ("buttons", 0.45), ("side", 0.55), ("prompts", 0.3), ("byline", 0.25), ("steps", 0.35), ("footer", 0.3)])
def test_furniture_of_a_group_left_out_of_the_fit(group, least):
    import random

    r, made, at = random.Random(6), [], []
    for k in range(150):  # a line of the group by itself, before or after the body of a page without the group
        mk = labelled._Maker(1000 + k)
        p, lang = mk.page(None, (group,)), r.choices(furniture_texts.LANGUAGES, [8, 3, 3, 2, 2, 2])[0]
        own = [i for i, (_, v) in enumerate(p) if v == 1]
        i = own[0] if r.random() < 0.5 else own[-1] + 1
        made.append([*p[:i], ("", -1), (mk.fill(furniture_texts.phrase(r, group, lang), "Acme", lang), 0), ("", -1), *p[i:]])
        at.append(sum(v >= 0 for _, v in p[:i]))
    x = body.Lines(Block(["\n".join(t for t, _ in p) for p in made]))
    line = np.searchsorted(x.page, np.arange(150)) + np.array(at)
    unseen, seen = ((~m.body(x)[line]).mean() for m in (body.model(labelled.PAGES, (), (group,)), body.model()))
    print(f"{group}: {unseen:.2f} found where left out, {seen:.2f} else")
    assert unseen >= least and seen > 0.88 and seen > unseen


def test_best_runs_is_optimal():
    r = np.random.default_rng(3)
    for _ in range(60):
        n = int(r.integers(1, 9))
        s = r.normal(size=n).round(2)
        value = lambda k: s[k].sum() - body.RUN_COST * (np.diff(np.concatenate([[0], k.astype(int)])) == 1).sum()  # noqa: E731,B023
        best = max(value(np.array([m >> i & 1 for i in range(n)], bool)) for m in range(1 << n))
        assert abs(value(body.best_runs(s, np.zeros(n, int))) - best) < 1e-9


def test_furniture(spark):
    df = pages(spark, [(1, PAGE, "u", 9), (2, None, None, None), (3, "", "u", 1), (None, PAGE, "u", 1), (1, PAGE, "u", 2), (5, " \n\n", "u", 0)])
    got = main_body.furniture(df).collect()
    assert sorted(r["line_no"] for r in got if r["page_id"] == 1) == sorted(FURNITURE * 2)
    assert sorted(r["line_no"] for r in got if r["page_id"] is None) == FURNITURE
    assert {r["page_id"] for r in got} == {1, None}
    b = {r["page_id"]: r["body"] for r in main_body.main_body(df).collect()}
    assert b[2] is None and b[3] == "" and b[5] == "" and b[1].startswith("# Configure salder") and "Share" not in b[1]
    assert main_body.furniture(df.limit(0)).count() == 0


# --- problem 2


def test_site_lines_against_brute_force(spark):
    rows = []
    for i in range(60):
        site = ["https://www.A.example:80/x", "http://a.example/y", "https://b.test/", None, "/rel"][i % 5]
        rows.append((i, f"Own line number {i} of this very page {sentences(4, i)}\n  Terms of  USE {i} | privacy policy\nshort one\nOnly some pages have this line\n" * (1 + i % 2) if i % 7 else None, site, i))
    df = pages(spark, rows)
    n, at = defaultdict(set), []
    for p, t, u, _ in rows:
        m = re.match(r"https?://(?:www\.)?([^/:]+)", (u or "").lower())
        if t is None or not m:
            continue
        for k, line in enumerate(t.split("\n"), 1):
            if sum(c.isalpha() for c in line) >= 16:
                key = (m[1], re.sub(r"\s+", " ", re.sub("[0-9]+", "#", line.strip().lower())))
                n[key].add(p)
                at.append((p, k, key))
    want = sorted((p, k) for p, k, key in at if len(n[key]) >= 10)
    assert want and sorted((r["page_id"], r["line_no"]) for r in site_lines.found(df).collect()) == want
    out = {r["page_id"]: r["cleaned"] for r in site_lines.without(df).collect()}
    assert len(out) == 60 and out[0] is None and "Terms" not in out[1] and out[3] == rows[3][1]
    assert site_lines.found(df.limit(0)).count() == 0


@pytest.mark.parametrize("others", [0, 300])
def test_lines_on_ten_pages_of_a_site_with_most_pages(spark, others):
    # line x of the first 200 stands on pages 10 x to 10 x + 9, the next hundred on nine pages, the last hundred on two
    on = [list(range(10 * x, 10 * x + 10)) for x in range(200)] + [list(range(9 * x, 9 * x + 9)) for x in range(100)] + [[x, 2999 - x] for x in range(100)]
    name = lambda x: "Shared sentence " + "".join(chr(97 + int(c)) for c in f"{x:03d}") + " stands here"
    lines = defaultdict(list)
    for x, p in enumerate(on):
        for q in p:
            lines[q].append(x)
    rows = [(i, "\n".join(name(x) for x in lines[i]) or "short", "https://one.test/p", 1) for i in range(3000)]
    rows += [(5000 + i, "short", "https://two.test/p", 1) for i in range(others)]
    want = sorted((q, k) for q in lines for k, x in enumerate(lines[q], 1) if x < 200)
    df = pages(spark, rows)
    assert len(want) == 2000 and sorted(tuple(r) for r in site_lines.found(df).collect()) == want
    out = {r["page_id"]: r["cleaned"] for r in site_lines.without(df).collect()}
    assert out[0] == "\n".join(name(x) for x in lines[0] if x >= 200) and len(out) == len(rows)


def test_lines_as_common_elsewhere_are_no_excess_over_other_sites(spark):
    rows = [(i, "This line stands on every page of all the sites\n" + ("Only the first site has this line on its pages\n" if i % 2 == 0 and i % 4 < 2 else "") + f"Own text {sentences(6, i)}", f"https://s{i % 2}.test/", 1) for i in range(400)]
    df = pages(spark, rows)
    by_rule, by_others = site_lines.found(df).collect(), site_lines.found(df, chance=None).collect()
    assert len(by_rule) == 500 and sorted(r["line_no"] for r in by_others) == [2] * 100
    got = {(r["n"], r["outside"]) for r in site_lines.repeated(df).collect()}
    assert got == {(200, 200), (100, 0)}
    one = df.where("url = 'https://s0.test/'")
    assert site_lines.found(one).count() == 300 and site_lines.found(one, chance=None).count() == 0


def test_threshold_of_the_false_discovery_rate():
    import math

    assert site_lines.threshold([], 0) == math.inf and site_lines.threshold([(2, 1000)], 1000) == math.inf
    r = np.random.default_rng(4)
    g = np.concatenate([r.chisquare(1, 20_000) * (r.random(20_000) < 0.5), np.full(500, 30.0)])
    steps = np.unique((g * site_lines.STEPS).astype(int), return_counts=True)
    t = site_lines.threshold(list(zip(steps[0].tolist(), steps[1].tolist())), len(g))
    false = (g[:20_000] >= t).sum()
    assert (g >= t).sum() >= 500 and false <= 0.08 * (g >= t).sum()


# --- problem 3


def test_titles():
    text = "first\n\n# A\n\n```\n# no\n~~~\n## no\n```\n<h2>B</h2>\n\nSet\n---\n\n**Bold**\n\n1.2 Numbered\n\n- item\n---\n    # code\n#4 no title\n\n## C ##\r\n"
    assert [text.split("\n")[i].strip() for i in pieces.title_lines(text)] == ["first", "# A", "<h2>B</h2>", "Set", "**Bold**", "1.2 Numbered", "## C ##"]


@pytest.mark.parametrize("text", ["x" * 25_000, "word " * 5000, "A sentence here. " * 1500, "\n\n".join(["# T", "para " * 300] * 20), "日本語。" * 4000])
def test_pieces_put_together_again(text):
    cuts = pieces.split(text)
    assert all(z - a <= pieces.LIMIT for a, z, _ in cuts) and cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (_, z, _), (a, _, _) in zip(cuts, cuts[1:]):
        assert a == z - pieces.OVERLAP
    assert text[: cuts[0][1]] + "".join(text[p[1] : c[1]] for p, c in zip(cuts, cuts[1:])) == text


@pytest.mark.parametrize("first, kind", [("word " * 300, "word"), ("One sentence. Words after it ", "word"), ("A sentence here. " * 40, "sentence")])
def test_long_runs_are_not_cut_where_an_earlier_boundary_is(first, kind):
    text = first + "x" * 6100 + " and more words"
    cuts = pieces.split(text)
    want = len(first)
    if want > pieces.OVERLAP:
        assert cuts[0] == (0, want, kind) and cuts[1][0] == want - pieces.OVERLAP
    else:  # no boundary past the overlap
        assert cuts[0][2] == "hard"
    assert all(z - a <= pieces.LIMIT for a, z, _ in cuts)


def test_pieces_by_tokens():
    text = "some words here. " * 100
    prefix = [i // 3 for i in range(len(text) + 1)]
    assert all(prefix[z] - prefix[a] <= 100 for a, z, _ in pieces.split(text, 100, 10, prefix))


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="needs the vocabulary files")
def test_pieces_by_tokens_of_a_tokenizer(spark):
    text = "# One\n\n" + "Some words here. " * 300 + "\n\n## Two\n\n" + "日本語の文です。" * 200
    df = pages(spark, [(1, text, "u", 1), (2, "short", "u", 1), (3, None, "u", 1), (4, "", "u", 1)])
    got = {}
    for r in pieces.pieces(df, limit=400, overlap=30, unit="tokens").collect():
        got.setdefault(r["page_id"], []).append(r)
    sizes = bpe.encoder(VOCAB).sizes_before(text)
    cuts = sorted(got[1], key=lambda r: r["piece_no"])
    assert sizes[-1] == len(bpe.encoder(VOCAB).encode([text])[0]) and len(cuts) > 3 and all(sizes[r["stop"]] - sizes[r["start"]] <= 400 for r in cuts)
    assert cuts[0]["piece"] + "".join(text[a["stop"] : b["stop"]] for a, b in zip(cuts, cuts[1:])) == text
    assert got[2][0]["boundary"] == "whole" and got[4][0]["piece"] == "" and 3 not in got
    with pytest.raises(ValueError):
        pieces.pieces(df, unit="pages")


@pytest.mark.parametrize("name", ["p2_clean", "p2_found", "p6_slices"])
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_queries_against_sql(spark, name):
    import duckdb

    from leafmill.llm import queries

    con = duckdb.connect()
    for t in ("page_results", "jobs"):
        con.execute(f"create view {t} as select * from read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    got = queries.queries()[name](spark, "/root/testdata/sf0.001").toPandas()
    want = con.execute(queries.oracle_sql()[name]).df()[list(got.columns)]
    key = lambda d: sorted(map(tuple, d.astype(str).values.tolist()))
    assert len(want) > 10 and key(got) == key(want)


def test_pieces_table(spark):
    df = pages(spark, [(1, "a\n" + "b. " * 4000, "u", 7), (2, "short", None, 1), (3, None, None, 1), (4, "", None, 1)])
    got = {(r["page_id"], r["piece_no"]): r for r in pieces.pieces(df).collect()}
    assert got[(2, 1)]["boundary"] == "whole" and got[(4, 1)]["piece"] == "" and (3, 1) not in got and (1, 3) in got
    assert [tuple(r) for r in pieces.titles(df).collect()] == [(1, 1)]


# --- problem 4


def test_residue(spark):
    prose = "# Configure salder\n\nEach batch copies its own tables, so a small key never blocks another one. When a server is slow, the parser drops all rows and keeps the connection open."
    cases = ["# Page not found\n\nThe page you are looking for may have been moved or deleted.", "# {{title}}\n\n" + prose, prose + "\n\nWelcome to ${product_name}, the fast one.", "Lorem ipsum dolor sit amet, consectetur adipiscing elit sed do eiusmod.", "You need to enable JavaScript to run this app.", "Bitte aktivieren Sie JavaScript, um diese Anwendung zu nutzen.", "Text goes here. Text goes here.", "404"]
    fine = [prose, prose + "\n\nWrite `{{ name }}` where the value belongs.", prose + "\n\n```\n{{ title }}\n```", prose + "\n\nThe server answers 404 Not Found when the page does not exist.", None, "", " \n"]
    df = pages(spark, [(i, t, "u", 1) for i, t in enumerate(cases + fine)])
    assert sorted(r["page_id"] for r in residue.found(df).collect()) == list(range(len(cases)))
    left = residue.clean_pages(df)
    assert left.columns == df.columns and sorted(r["page_id"] for r in left.collect()) == list(range(len(cases), len(cases) + len(fine)))


def dressed(body_lines, r):
    """A page of furniture only, drawn by the labelled generator, around the given lines."""
    page = labelled._Maker(int(r.integers(1 << 30))).page()
    own = [i for i, (_, label) in enumerate(page) if label == 1]
    rest = [t for i, (t, label) in enumerate(page) if label < 1 and i < own[0]], [t for i, (t, label) in enumerate(page) if label < 1 and i > own[-1]]
    return "\n".join([*rest[0], "", *body_lines, "", *rest[1]])


@pytest.mark.parametrize("family, least", [("codes", 0.45), ("lost", 0.5), ("broken", 0.55), ("standard", 0.5), ("refused", 0.4), ("scripts", 0.1), ("wait", 0.35), ("checks", 0.1), ("traces", 0.15), ("blanks", 0.2), ("lorem", 0.0), ("keys", 0.1), ("unwritten", 0.25)])
def test_residue_of_a_kind_left_out_of_the_fit(family, least):
    import random

    r, draw = np.random.default_rng(2), random.Random(77)
    m = residue.models(11, (family, "mixed"))
    texts = [dressed([residue_texts.FAMILIES[family](draw)], r) for _ in range(150)]
    flag = residue._cases(texts, body.model(), m, residue.TOTAL, residue.MEAN, residue.COVERAGE)
    print(f"{family}: {flag.mean():.2f} of the pages of a kind left out of the fit")
    assert flag.mean() >= least


def test_residue_alone_and_between_furniture():
    import random

    r, draw = np.random.default_rng(3), random.Random(99)
    texts = [f(draw) for f in residue_texts.FAMILIES.values() for _ in range(20)] + [residue_texts.placeholder(draw) for _ in range(60)]
    alone = residue._cases(texts, body.model(), residue.models(), residue.TOTAL, residue.MEAN, residue.COVERAGE)
    between = residue._cases([dressed([t], r) for t in texts], body.model(), residue.models(), residue.TOTAL, residue.MEAN, residue.COVERAGE)
    print(f"alone {alone.mean():.3f}, between furniture {between.mean():.3f}")
    assert alone.mean() > 0.94 and between.mean() > 0.94
    prose = [" ".join(labelled._Maker(500 + k).sentence("Halden", furniture_texts.LANGUAGES[k % 5]) for _ in range(3)) for k in range(100)]
    assert residue._cases([dressed([p], r) for p in prose], body.model(), residue.models(), residue.TOTAL, residue.MEAN, residue.COVERAGE).mean() < 0.02


def test_placeholders_in_nested_lists_and_code():
    flag = lambda t: bool(residue._cases([t], body.model(), residue.models(), residue.TOTAL, residue.MEAN, residue.COVERAGE)[0])
    prose = "# Configure salder\n\nEach batch copies its own tables, so a small key never blocks another one.\n\n"
    assert flag(prose + "- The first entry of the list\n    - Welcome to {{ page.title | default: 'a very long text that stands for the title of this page' }} again")
    assert not flag(prose + "    x = {{ page.title }}\n    y = 2")
    assert flag("TBD: the author of this page, who will be named by the editors in the coming weeks") and not flag("")


# --- problem 5


def test_near_duplicates_against_brute_force(spark):
    rows, r = [], np.random.default_rng(5)
    for g in range(30):
        base = sentences(120, 1000 + g).split()
        for k in range(4):
            w = list(base)
            for _ in range(k * 2):
                w[int(r.integers(len(w)))] = f"e{int(r.integers(999))}"
            rows.append((g * 10 + k, "# Title\n\n" + " ".join(w) + ".", "u", 1))
    rows += [(901, rows[0][1], "v", 1), (902, "too short", "u", 1), (903, None, "u", 1), (904, "", "u", 1), (None, rows[0][1], "u", 1)]
    df = pages(spark, rows)
    sets = {}
    for p, t, *_ in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if p is not None and len(w) >= 60:
            sets[p] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    ids = sorted(sets)
    want = sorted((a, b) for a in ids for b in ids if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]))
    assert len(want) > 100 and sorted(tuple(x) for x in near.found(df).collect()) == want
    cls = {r["page_id"]: r for r in near.classes(df).collect()}
    assert cls[901]["class"] == 0 and cls[0]["copies"] == 2 and 902 not in cls
    assert near.found(df.limit(0)).count() == 0


def test_near_duplicates_among_pages_of_one_template(spark):
    rows = [(10_000 + i, "# Title\n\n" + sentences(62, 90_000 + i) + ".", "u", 1) for i in range(2500)]
    for g in range(60):  # the template stands on more than 0.1 % of the pages, most pairs lie just above the threshold
        common, shared, own_a, own_b = (122, 61, 52, 62) if g % 2 else (102, 52, 46, 47)
        start = sentences(common, 7 + g % 2) + " " + sentences(shared, 100 + g)
        for k, own in enumerate((own_a - g % 5, own_b)):
            rows.append((g * 10 + k, "# Title\n\n" + start + " " + sentences(own, 1000 + g * 10 + k) + ".", "u", 1))
    sets = {}
    for p, t, *_ in rows:
        w = re.findall(r"[^\W_]+", t.lower())
        sets[p] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    ids = sorted(p for p in sets if p < 10_000)
    sim = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in ids for b in ids if a < b}
    want = sorted(p for p, x in sim.items() if x >= 0.6)
    assert len(want) >= 50 and sum(0.6 <= sim[p] <= 0.65 for p in want) >= 50
    assert sorted(tuple(x) for x in near.found(pages(spark, rows)).collect()) == want


def test_large_copy_classes_are_linked_through_one_page(spark):
    t = "# Title\n\n" + sentences(100, 1) + "."
    other = t.replace("# Title", "# Changed")
    df = pages(spark, [(i, t, "u", 1) for i in range(5)] + [(9, other, "u", 1)])
    assert sorted(tuple(x) for x in near.found(df, copies=3).collect()) == [(0, 1), (0, 2), (0, 3), (0, 4), (0, 9)]


@pytest.mark.parametrize("hot", [3, 20])
def test_cells_of_crowded_blocks_lose_no_pair(spark, monkeypatch, hot):
    r = np.random.default_rng(6)
    base = sentences(120, 1).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(i % 5):
            w[int(r.integers(len(w)))] = f"e{int(r.integers(99))}"
        rows.append((i, " ".join(w[: 120 - i % 3]) + ".", "u", 1))
    df = pages(spark, rows)
    want = sorted(tuple(x) for x in near.found(df).collect())
    monkeypatch.setattr(near, "HOT", hot)
    monkeypatch.setattr(near, "PART", 2)
    assert len(want) > 500 and sorted(tuple(x) for x in near.found(df).collect()) == want


def test_all_copies_of_a_large_class_are_paired(spark):
    t = "# Title\n\n" + sentences(100, 1) + "."
    df = pages(spark, [(i, t, "u", 1) for i in range(1001)] + [(2000 + i, t.replace("# Title", "# Changed"), "u", 1) for i in range(2)])
    got = near.found(df)
    assert got.count() == got.distinct().count() == 1003 * 1002 // 2 and got.where("page_id_a >= page_id_b").count() == 0


def test_groups_of_near_duplicates(spark):
    def edited(k, seed):  # 120 words of which the first k times 15 are replaced: neighbours in k are near-duplicates, others are not
        return "# Title\n\n" + " ".join([sentences(15, seed + 50 + j) if j < k else sentences(15, seed + j) for j in range(8)]) + "."

    rows = [(g * 100 + k, edited(k, 1000 * (g + 1)), "u", 1) for g in range(3) for k in range(7)] + [(900, edited(3, 1000), "v", 1), (901, "# Title\n\n" + sentences(80, 77) + ".", "u", 1)]
    df = pages(spark, rows)
    pair = {tuple(r) for r in near.found(df).collect()}
    assert (0, 6) not in pair and all((g * 100 + k, g * 100 + k + 1) in pair for g in range(3) for k in range(6))
    group = {r["page_id"]: r["group"] for r in near.classes(df).collect()}
    assert group == {p: 0 if p == 900 else p if p == 901 else p // 100 * 100 for p, *_ in rows}
    r = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(1, 40)] + [(int(a), int(b)) for a, b in np.sort(r.integers(50, 120, (45, 2)), axis=1) if a < b]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert {x["class"]: x["root"] for x in near.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == least


# --- problems 6 and 7

TEXTS = ["it's 're'll we've 'x ''s  'd\n\n 'm\t\t't", "a  b \n", "  ", "\n", "", None, "'s", "x'Re 12'34's", "日本語 テスト's 👍🏽", "\x1c \x1d a", "don't" * 50, "a" * 3000, "don't", "<|endoftext|>", "🏳️‍🌈" * 20]


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="needs the vocabulary files")
def test_encoder_equals_the_public_libraries():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    enc = bpe.Encoder(VOCAB)
    ids, n = enc.encode(TEXTS)
    at = np.concatenate([[0], np.cumsum(n)])
    for i, x in enumerate(TEXTS):
        assert ids[at[i] : at[i + 1]].tolist() == (t.encode(x, add_special_tokens=False).ids if x else []), x
    assert enc.count(TEXTS).tolist() == n.tolist()


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="needs the vocabulary files")
def test_token_tables(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", None), (3, "a b", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in tokens.ids(df).collect())
    assert got[1][1] == [] and got[2][1] == [] and got[0][1] == got[3][1] and len(got[0][1]) == 2
    p = spark.createDataFrame([(1, "a b", "j", "EN-us", "https://h/x"), (2, "a b", None, None, None), (3, None, "j", "en", "rel"), (4, "c", "k", "", "https://h/y")], "page_id long, content string, job_id string, lang string, url string")
    jobs = spark.createDataFrame([("j", ("wiki",)), ("k", (None,))], "id string, config struct<profile string>")
    assert {r["page_id"]: r["n_tokens"] for r in tokens.page_tokens(p).collect()} == {1: 2, 2: 2, 3: 0, 4: 1}
    tot = {(r["dimension"], r["value"]): (r["pages"], r["tokens"]) for r in tokens.totals(p, jobs).collect()}
    assert tot[("profile", "wiki")] == (2, 2) and tot[("profile", None)] == (2, 3) and tot[("language", "en")] == (2, 2) and tot[("language", None)] == (2, 3) and tot[("host", "h")] == (2, 3) and tot[("host", None)] == (2, 2)


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="needs the vocabulary files")
def test_wide_tokens_merge_alike():
    r = bpe.encoder(VOCAB).ranks
    g = np.random.default_rng(3)
    for letters in (b"ab", b"abcdefghijklmnopqrstuvwxyz", bytes(range(128, 256))):
        for n in (1, 2, 7, 300, 2000):
            ids = r.byte[np.frombuffer(letters, np.uint8)[g.integers(len(letters), size=n)]]
            a = r.merge(ids[None, :])[0]
            assert (a[a >= 0] == r.merge_wide(ids)).all()
    text = "".join(g.choice(list("abcdefgh"), 200_000))
    ids, _ = bpe.encoder(VOCAB).encode([text])
    assert r.bytes[ids].sum() == 200_000


# --- problem 8


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="needs the vocabulary files")
def test_mix_reaches_its_shares(spark):
    rows = [(i, sentences(40 + i % 30, i), "a" if i % 3 else "b") for i in range(1500)] + [(5000 + i, sentences(50, i), "c") for i in range(20)] + [(9000, None, "a"), (9001, "", "b"), (9002, "x y", None), (9003, "x", "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {"a": 0.5, "b": 0.4, "c": 0.1, "none": 0.0}
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("c", 0.1, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, t).collect()
    cap = {"a": 1, "b": 2, "c": 3}
    assert m and all(1 <= r["copies"] <= cap[r["source"]] for r in m) and len({r["doc_id"] for r in m}) == len(m)
    got = {r["source"]: r["reached_share"] for r in mixing.shares(df, t).collect()}
    assert all(abs(got[s] - want[s]) < 0.01 for s in want)
    assert mixing.mix(df.limit(0), t).count() == 0 and mixing.mix(df, t.limit(0)).count() == 0


def test_rates_follow_memberships():
    r = np.random.default_rng(8)
    k, lab = 5, np.repeat(np.arange(5), 8)
    tok = r.uniform(1e5, 3e6, 40)
    expect = (0.6 * np.eye(k)[lab] + 0.4 * r.dirichlet(np.full(k, 0.3), 40)) * tok[:, None]
    have, cap = np.bincount(lab, tok, k), np.array([1, 2, 3, 1, 2.0])
    share = np.array([0.3, 0.25, 0.2, 0.15, 0.1])
    goal = share * (cap * have / share).min()
    fit = mixing._descend(expect, tok, lab, cap[lab], goal)
    miss = lambda x: (((expect.T @ x) / goal - 1) ** 2).sum()
    assert (fit >= 0).all() and (fit <= cap[lab]).all() and np.allclose(np.bincount(lab, tok * fit, k), goal, rtol=1e-6)
    assert max(np.ptp(fit[lab == i]) for i in range(k)) > 0.1 and miss(fit) < 0.5 * miss((goal / have)[lab])
    for _ in range(300):  # no other rates that keep the labels' tokens come closer
        other = mixing._keep_labels(fit + r.normal(size=40) * r.choice([0.01, 0.1, 1.0]), tok, lab, cap[lab], goal)
        assert miss(other) > miss(fit) - 1e-6


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="needs the vocabulary files")
def test_mix_takes_less_of_what_reads_like_an_overfull_source(spark):
    def words(letter, i):
        g = np.random.default_rng(i)
        return " ".join(f"{letter}{x}" for x in g.integers(60, size=50))

    # a third of b reads like a, of which the targets then hold too much
    rows = [(i, words("aa", i), "a") for i in range(600)] + [(1000 + i, words("aa" if i % 3 == 0 else "bb", 5000 + i), "b") for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], "source string, target_share double, max_repeats int")
    m = mixing.mix(df, t).collect()
    used = [sum(r["copies"] * r["n_tokens"] for r in m if r["source"] == s) for s in "ab"]
    assert abs(used[0] / sum(used) - 0.5) < 0.01 and max(r["copies"] for r in m if r["source"] == "a") == 1 and max(r["copies"] for r in m) <= 2
    like_a, like_b = (sum(r["copies"] for r in m if r["doc_id"] >= 1000 and ((r["doc_id"] - 1000) % 3 == 0) == x) / n for x, n in ((True, 400), (False, 800)))
    assert like_b > like_a + 0.1


# --- problem 9


def test_quality(spark):
    words = spark.createDataFrame([("en", w, 1) for w in "the of and to a in is it that for on as with was at by be this from or not but".split()], "lang string, word string, freq_rank int")
    prose = "The server reads the file and writes it to the index. It is not a problem that the queue was slow, but the log is kept for a day. "
    good = [prose * 2 + f"This is run {i} of the test with a note on the box." for i in range(40)]
    bad = [f"|a{i}|{i}|{i * 7}|\n" * 30 for i in range(8)] + ["\n".join(f"entry{i}{j} value{j}" for j in range(20)) for i in range(8)] + [f"2024-01-0{j} ERROR [x] code={j}\n" * 12 for j in range(1, 5)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad + ["", None, " \n"])], "doc_id long, text string")
    kinds = {r["doc_id"]: r["text_type"] for r in quality.classify(df, words).collect()}
    assert Counter(kinds.values()) == {"prose": len(good), "other": len(bad), "blank": 3}
    assert sorted(r["doc_id"] for r in quality.found(df, words).collect()) == list(range(len(good), len(good) + len(bad)))
    s = {r["doc_id"]: r for r in quality.statistics(spark.createDataFrame([(1, "The cat, it ran.\nno end")], "doc_id long, text string"), words).collect()}[1]
    assert (s["n_words"], s["punct_line_share"], round(s["symbol_ratio"], 3), round(s["mean_word_length"], 2), round(s["common_word_share"], 3)) == (6, 0.5, round(2 / 18, 3), round(16 / 6, 2), round(2 / 6, 3))
    assert quality.found(df.limit(0), words).count() == 0


def test_blocks_cover_all_texts():
    t = ["a" * 10, None, "b" * 1000, "", "c"]
    assert [i for a, z in blocks(t, 50) for i in range(a, z)] == list(range(5)) and list(blocks([])) == []
