"""Tag-path ratios: against a plain reckoning of the same rule, on hostile pages, and that scores decide."""

import math
import random
import re
import time

import pytest

from nearfield.llm import htmltext as H

TEXT = "Some long text, with marks, that goes on and on for a while; and then it ends."


def plain(page):
    """The rule on tuples of steps, with no sharing and no order of work."""
    paths, blocks = H.blocks_of(page)
    rows = [(paths.steps(b.path), "".join(b.texts), b.linked, b.size, b.path) for b in blocks]
    if not rows:
        return ""
    kinds = sorted({r[0] for r in rows})
    ratio = {}
    for k in kinds:
        own = [r for r in rows if r[0] == k]
        ratio[k] = (sum(r[3] - r[2] for r in own) / len(own), sum(len(re.findall(H.MARKS, r[1])) for r in own) / len(own), sum(r[3] - r[2] for r in own) / sum(r[3] for r in own))
    smooth = []
    for i in range(len(rows)):
        near = [(math.exp(-((i - j) ** 2) / 2), ratio[rows[j][0]]) for j in range(len(rows)) if abs(i - j) <= H.SMOOTH]
        smooth.append([sum(w * v[c] for w, v in near) / sum(w for w, _ in near) for c in (0, 1)])
    score = {}
    for k in kinds:
        own = [s for s, r in zip(smooth, rows, strict=True) if r[0] == k]
        x, y = ((sum(s[c] for s in own) / len(own) * ratio[k][c]) ** 0.5 for c in (0, 1))
        number = next(r[4] for r in rows if r[0] == k)
        score[k] = math.log(2 + x) * (1 + math.log(1 + y)) * ratio[k][2] * paths.prior(number)
    passed = {k for k in kinds if score[k] >= max(H.LEAST, H.SHARE * max(score.values()))}
    if not passed:
        return ""
    root = min(passed)
    while not all(k[: len(root)] == root for k in passed) or (root and root[-1].split(".")[0] in H.WITHIN):
        root = root[:-1]
    of = {r[0]: r[4] for r in rows}
    marked = any(paths.marked[of[k]] for k in passed)
    out = []
    for k, text, linked, size, number in rows:
        inside = k[: len(root)] == root and not paths.denied(number) and (paths.marked[number] or not marked)
        if k in passed or (inside and (linked < size or paths.marked[number])):
            out.append(" ".join(text.split()))
    return " ".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_text_is_the_rules(seed):
    rng = random.Random(seed)

    def element(depth):
        if depth == 0 or rng.random() < 0.3:
            words = " ".join(rng.choice(["one", "two,", "three.", "&lt;four", "five"]) for _ in range(rng.choice([1, 3, 40])))
            return f"<a href=x>{words}</a>" if rng.random() < 0.2 else words
        tag = rng.choice(["div", "p", "ul", "li", "section", "article", "nav", "b", "h2", "td", "blockquote", "main", "aside"])
        name = rng.choice(["", "", " class=content", " class='ad box'", " id=comments", " class=x"])
        close = f"</{tag}>" if rng.random() < 0.9 else ""
        return f"<{tag}{name}>" + "".join(element(depth - 1) for _ in range(rng.randint(1, 4))) + close

    page = "<body>" + "".join(element(5) for _ in range(4)) + "</body>"
    assert H.main_text(page) == plain(page)


def test_scores_decide(monkeypatch):
    """Without names: dense text stays and link lists go; with equal scores everything stays."""
    page = "<div class=q1><ul>" + "<li><a href=x>Link</a></li>" * 9 + "</ul></div>" + f"<div class=q2><p>{TEXT}</p><p>{TEXT}</p></div><div class=q3>x</div>" + "<div class=q4><a>One</a> <a>two</a></div>"
    assert "Link" not in H.main_text(page) and "two" not in H.main_text(page) and H.main_text(page).startswith(f"{TEXT} {TEXT}")
    monkeypatch.setattr(H, "path_scores", lambda paths, blocks: {b.path: 5.0 for b in blocks})
    assert "Link" in H.main_text(page) and "two" in H.main_text(page)


def test_text_outside_an_empty_article_stays():
    assert H.main_text(f"<article>Ad</article><div><p>{TEXT}</p><p>{TEXT}</p></div>").endswith(f"{TEXT} {TEXT}")


@pytest.mark.parametrize(
    "page",
    ["<div>x " * 100_000, "<a " * 300_000, "<div>" * 200_000, '<a ">"' * 100_000 + "'>", "<td>" + "<b>" * 90_000 + "<hr>" * 90_000, "<div>" * 90_000 + "</b>" * 90_000, "<ul>" + "<li>x" * 100_000, "<!--" * 200_000, "<script " * 100_000, "&" * 500_000],
    ids=["text in divs", "open tags", "divs", "quotes", "rules", "closings", "items", "comments", "scripts", "references"],
)
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    H.main_text(page)
    assert time.perf_counter() - began < 5  # about a second; what grew with the square took hours


def test_long_text_is_whole():
    assert H.main_text(f"<article><p>{'word, ' * 400_000}</p></article>") == ("word, " * 400_000).strip()
