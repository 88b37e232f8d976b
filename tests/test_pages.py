"""The main content of pages against marked pages and a plain version."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import pages

PROSE = "Water boils at a lower temperature on a mountain than at the sea."
MARKED = [
    (f"<body><nav><a href=/a>Home</a> <a href=/b>News</a></nav><div class='x y'><h2>Boiling</h2><p>{PROSE}<p>{PROSE}</div><footer>{PROSE}</footer></body>", f"## Boiling\n\n{PROSE}\n\n{PROSE}"),
    (f"<div class='Sidebar x'><p>{PROSE} {PROSE} {PROSE}</p></div><main><ul><li>one thing<li>another thing</ul><p>See <a href='/t?a=1&amp;b=2'>the  table</a>.</p></main>", "- one thing\n\n- another thing\n\nSee [the table](/t?a=1&b=2)."),
    ("<main><table><tr><th>metal</th><th>melts</th></tr><tr><td>iron</td><td>1538 &deg;C</td></tr></table></main>", "| metal | melts |\n\n| iron | 1538 °C |"),
    (f"<p>{PROSE}<script>var p = '<p>long text of a script that is not shown</p>';</script><br>On.</p><p><a href=/x>{PROSE}</a></p>", f"{PROSE} On."),
    ("<nav>only a menu here</nav>", ""),
    ("<h1>Salt &amp</h1><p>Pepper &ampand &copy; more</p>", "# Salt &\n\nPepper &and © more"),
    ("a text without any tag", "a text without any tag"),
    ("", ""),
    (None, ""),
    (f"<div><p>{PROSE}</p></div></div></p></table><div><p>{PROSE}</p></div", f"{PROSE}"),
]


def test_marked_pages(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(MARKED)], "i int, html string")
    got = {r.i: r.t for r in rows.select("i", pages.main_text("html").alias("t")).collect()}
    assert {i: got[i] for i in range(len(MARKED) - 1)} == {i: want for i, (_, want) in enumerate(MARKED[:-1])}
    assert got[len(MARKED) - 1].startswith(PROSE)


def test_the_best_part_by_trying_all():
    """Every part of random pages is weighed by its own text; none outweighs the one chosen."""
    import random

    r = random.Random(5)

    def made(depth):
        words = lambda: " ".join(r.choice(["stone", "river", "a", "hill"]) for _ in range(r.randint(1, 9)))
        if depth == 0 or r.random() < 0.3:
            return f"<p>{words()}" + (f" <a href=u>{words()}</a>" if r.random() < 0.5 else "") + "</p>"
        tag = r.choice(["div", "section", "nav"])
        return f"<{tag}>" + "".join(made(depth - 1) for _ in range(r.randint(1, 3))) + f"</{tag}>"

    for _ in range(50):
        html = made(4)
        blocks = pages.blocks_of(html)
        page = pages._Page()
        page.feed(html)
        page.close()
        page.flush()
        under = lambda i, top: i == top or (i > 0 and under(page.parent[i], top))  # noqa: E731, B023
        worth = lambda top: sum(-len(t) if page.around[at] else len(t) - 3 * n for at, _, t, n in page.blocks if under(at, top))  # noqa: E731, B023
        best = max(map(worth, range(len(page.tag))))
        mine = sum(len(b["text"]) - 3 * b["link_chars"] for b in blocks)
        assert (not blocks and best <= 0) or mine >= best > 0


@pytest.mark.parametrize("n,want", [(3, "a b c\n\n[Content truncated at 3 words]"), (4, "a  b\nc d"), (9, "a  b\nc d")])
def test_cap(spark, n, want):
    assert spark.range(1).select(pages.capped(F.lit("a  b\nc d"), n)).first()[0] == want
