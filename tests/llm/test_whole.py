"""Nothing is dropped that a stage should keep."""

import pytest

from nearfield.llm import htmltext, simhash

BODY = "".join(f"<p>Long paragraph number {k}, with commas, with words, and with a full stop.</p>" for k in range(12))
PLAIN = " ".join(f"Long paragraph number {k}, with commas, with words, and with a full stop." for k in range(12))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1>Title</h1><div class='content'>{BODY}</div></article>", f"Title {PLAIN}"),
        (f"<body><nav>Menu, here.</nav><main><h1>Title</h1><div class=lead>Short.</div><section>{BODY}</section><section class=end><p>Bye.</p></section></main><footer>Foot, it is.</footer></body>", f"Title Short. {PLAIN} Bye."),
        (f"<body><nav>Menu, here.</nav><div class=wrap><h1>Title</h1><div class=content>{BODY}</div><div class=more><p>One short section, at the end.</p></div></div></body>", f"Title {PLAIN} One short section, at the end."),
        (f"<body><div class=lead><p>A lead, of some words.</p></div><div class=content>{BODY}</div><div class=sidebar>Side, bar.</div></body>", f"A lead, of some words. {PLAIN}"),
        (f"<body><article class='post first'>{BODY}</article><article class=post><p>Brief, second.</p></article></body>", f"{PLAIN} Brief, second."),
        (f"<body><td>{BODY}</td></body>", PLAIN),
    ],
)
def test_only_boilerplate_is_dropped(page, text):
    assert htmltext.main_text(page) == text


def test_each_group_of_copies_keeps_a_row(spark):
    texts = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(8)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[3]), (7, texts[4]), (7, texts[4]), (9, texts[4]), (3, texts[5]), (None, texts[5]), (7, texts[5]), (None, None), (None, "")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(0, texts[0]), (0, texts[1]), (0, texts[2]), (7, texts[3]), (7, texts[4]), (3, texts[5]), (0, "")])
