"""Nearest neighbours and main text."""

import os
import re
import time

import numpy as np

from quillgraph.llm import extraction, neighbours

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype(np.float32) * rng.uniform(0.2, 3, (3000, 1)).astype(np.float32)
    x[100:160] = x[100]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = neighbours.nearest(df.where("vec_id % 20 = 0"), neighbours.index(df, 11, shard_size=1000), 10).toPandas()
    full = x.astype(np.float64)
    hit = 0
    for q, part in got.groupby("query_id"):
        scores = full @ full[q]
        order = [k for k in np.lexsort((np.arange(3000), -scores)) if k != q][:10]
        part = part.sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 11))
        assert np.allclose(part["score"], scores[part["vec_id"]], rtol=1e-12)
        pairs = list(zip(-part["score"], part["vec_id"], strict=True))
        assert pairs == sorted(pairs)
        hit += len(set(order) & set(part["vec_id"]))
    assert got["query_id"].nunique() == 150 and hit >= 0.95 * 1500


def test_shards_are_whole(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, rng.normal(size=4).tolist()) for k in range(500)], "vec_id long, embedding array<double>")
    found = neighbours.index(df, 5, shard_size=100)
    held = [i for s in range(found.shards) if found.shard(s) for i in found.shard(s)["ids"].tolist()]
    assert sorted(held) == list(range(500))


def test_later_shards_bring_few_contenders():
    rng = np.random.default_rng(3)
    x, q = np.round(rng.normal(size=(400, 3)), 1), np.round(rng.normal(size=(30, 3)), 1)  # with ties
    hits, k = np.stack([rng.permutation(400)[:60] for _ in q]), 5
    hits[:, 50:], hits[0, 2:], hits[1] = -1, -1, -1
    least = np.where(np.arange(30) % 2, -np.inf, np.sort((q @ x.T), 1)[:, -3])
    got = dict(neighbours.contenders({"vectors": x}, hits, q, least, k))
    for row in range(30):
        scores = {int(n): float((x[n] * q[row]).sum()) for n in hits[row] if n >= 0}
        last = sorted(scores.values())[-k - 1] if len(scores) > k else -np.inf
        want = {n: v for n, v in scores.items() if v >= max(last, least[row])}
        assert dict(got.get(row, [])) == want
    assert len(got) < 30


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="content"><h1>Head &amp; line</h1><p>First   para
graph&nbsp;here.<br>more</p><p>x</p><aside>side</aside><form><input value="q"><button>Go</button></form><p>Last &#233; &lt;b&gt;</p></div>
<!-- <p>hidden</p> --><div class="ad">Buy</div><section id="comments"><p>reader says</p></section><footer>foot</footer></body></html>"""


def test_main_text():
    body = "Head & line\nFirst para graph here. more\nx\nLast é <b>"
    assert extraction.main_text(PAGE) == body
    marked = PAGE.replace('<div class="content">', "<article>").replace("</p></div>\n<!--", "</p></article>\n<p>outside</p><!--")
    assert extraction.main_text(marked) == body
    assert extraction.main_text("<nav><a>x</a></nav><footer>y</footer>") == ""
    assert extraction.main_text("<article><p><b>A.<br><p>B<p>C</article>") == "A.\nB\nC"


def test_surge_and_dive():
    assert extraction.stretches(np.array([0, 0, 5, 0, 0, 0, 0, 7, 1])) == [(2, 5), (7, 9)]
    page = "<div>" + "".join(f"<div>{'words ' * 30}</div>" for _ in range(5)) + "</div><div><a href=x>short link</a></div>"
    assert extraction.main_text(page) == "\n".join([("words " * 30).strip()] * 5)


def test_short_sections_and_link_lines_of_unmarked_pages():
    long, short = ("words " * 170).strip(), ("more " * 40).strip()
    assert extraction.main_text(f"<body><div>{long}</div><div class=ad>x</div><div>{short}</div></body>") == f"{long}\n{short}"
    rows = f"<div><div><p>{long}</p></div></div><div class=ad>x</div><div><section><p>{short}</p></section></div><div class=ad>x</div><div class=ad>y</div><div><div><p>end</p></div></div>"
    assert extraction.main_text(f"<body>{rows}</body>") == f"{long}\n{short}\nend"
    sources = "<ul><li><a href=x>First source of this</a></li><li><a href=y>Second source</a></li></ul>"
    page = f"<body><div><a href=/>Home</a> <a href=/a>About</a></div><div><p>{long}</p>{sources}</div></body>"
    assert extraction.main_text(page) == f"{long}\nFirst source of this\nSecond source"


def test_wrappers_named_like_boilerplate():
    long, ad, teaser = ("words " * 60).strip(), "<div class=ad>Buy</div>", "<div class=related><article>Read this too</article></div>"
    for name in ("layout has-sidebar", "no-sidebar", "nav-open", "with-header", "post no-comments"):
        assert extraction.main_text(f"<body><div class='{name}'><nav>Home</nav><article>{long}</article>{ad}{teaser}</div></body>") == long
    for start, end in (("<form action=x>", "</form>"), ("<div class='layout has-sidebar'>", "</div>"), ("<div class=nav-open><form>", "</form></div>")):
        assert extraction.main_text(f"<body><p>Top</p>{start}<nav>Home</nav><article>{long}</article>{ad}{end}</body>") == long
        assert extraction.main_text(f"<body>{start}<nav>Home</nav><div><p>{long}</p></div>{ad}{end}</body>") == long
    for other in (f"<div class=comments>{long}</div>", f"<nav>{long}</nav>", f"<div hidden>{long}</div>", f"<div class=menu><a href=x>{long}</a></div>", f"<article class=x>{long}</article>{teaser}"):
        assert extraction.main_text(f"<body><div><p>Short text</p></div>{other}</body>") == (long if "class=x" in other else "Short text")


def test_marks_do_not_decide():
    """Without the marks, the given pages have the same text; where only teasers are marked, the long stretch outside is not lost."""
    import pyarrow.parquet as pq

    if os.path.isdir(SF):
        for page in pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist():
            bare = re.sub(r"<(/?)(article|main)\b", r"<\1div", page, flags=re.I)
            assert extraction.main_text(bare) == extraction.main_text(page) != ""
    long = "".join(f"<p>{'word ' * 60}{k}</p>" for k in range(5))
    text = extraction.main_text(f"<body><div>{long}</div><nav>n</nav><article><a href=x>Teaser</a></article><article>More</article></body>")
    assert text.split("\n")[:5] == [f"{'word ' * 60}{k}" for k in range(5)]


def test_stretches_by_brute_force():
    rng = np.random.default_rng(3)
    for window in (1, 2, 3, 5):
        for _ in range(50):
            lengths = rng.integers(0, 4, 40) * (rng.random(40) < 0.4)
            sums = [sum(lengths[max(0, i - window + 1) : i + 1]) for i in range(40)]
            surges = [i for i in range(40) if sums[i] > 0 and (i == 0 or sums[i - 1] == 0)]
            dives = [next((j for j in range(i, 40) if sums[j] == 0), 40) for i in surges]
            assert extraction.stretches(lengths, window) == list(zip(surges, dives, strict=True))


def test_unclosed_tags_take_linear_time():
    def seconds(n):
        start = time.perf_counter()
        assert extraction.main_text("<b>x</i> " * n) and extraction.main_text("<b><i>x " * n)
        return time.perf_counter() - start

    seconds(500)
    assert min(seconds(16_000) for _ in range(3)) < 20 * min(seconds(2_000) for _ in range(3))


def test_registered_queries(spark):
    """The registered queries on given tables: recall against all pairs, and texts against the extraction of each page."""
    import pyarrow.parquet as pq

    if not os.path.isdir(SF):
        return
    pages = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    got = {r["page_id"]: r for r in extraction.op6_html_extraction(spark, SF).collect()}
    assert len(got) == len(pages) and all(got[p["page_id"]]["text"] == extraction.main_text(p["html"]) and got[p["page_id"]]["n_chars"] == len(got[p["page_id"]]["text"]) for p in pages)
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    ids, x = np.array(table["vec_id"]), np.array(table["embedding"], np.float64)
    found = neighbours.op7_nearest_neighbours(spark, SF).toPandas()
    hit = total = 0
    for q in ids[ids % 20 == 0]:
        scores = x @ x[ids == q][0]
        order = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        part = found[found["query_id"] == q].sort_values("rank")
        assert part["rank"].tolist() == list(range(1, 21)) and np.allclose(part["score"], [scores[ids == i][0] for i in part["vec_id"]], rtol=1e-12)
        hit, total = hit + len(set(order) & set(part["vec_id"])), total + 20
    assert hit >= 0.9 * total
