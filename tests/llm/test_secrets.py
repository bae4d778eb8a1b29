"""Novelty by itself: what it finds with the patterns off, and what it leaves alone."""

import random
import string

from nearfield.llm import secrets

WORDS = "the service reads its settings from a file and then starts the workers which wait for requests until the operator stops them".split()
NAMES = [
    "your_api_key_placeholder_value", "example_access_token", "authorization_header_value", "password_reset_instructions", "client_credentials_document",
    "abcdefghijklmnopqrstuvwxyz", "xxxxxxxxxxxxxxxxxxxxxxxx", "connection_string_settings", "application/json-charset", "aws_access_key_id_example",
]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def key(rng):
    kind = rng.randrange(3)
    letters = (string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters)[kind]
    return "".join(rng.choice(letters) for _ in range(rng.choice([20, 32, 40])))


def test_recall_and_precision_with_the_patterns_off():
    rng = random.Random(5)
    novelty = secrets.Novelty()
    caught = wrong = 0
    for k in range(300):
        value = key(rng)
        shape = ["the access_key is {} now", 'bearer {}"', "{}  # private key of the server", "signature of it: ({})"][k % 4]
        text = f"{prose(rng, 40)} {shape.format(value)} {prose(rng, 40)}"
        at = text.index(value)
        caught += secrets.novel_spans(text, novelty) == [secrets.Span("novel", at, at + len(value))]
        wrong += len(secrets.novel_spans(f"{prose(rng, 40)} {shape.format(rng.choice(NAMES))} {prose(rng, 40)}", novelty))
    assert caught >= 0.95 * 300 and wrong <= 0.05 * 300


def test_a_repeated_key_does_not_vouch_for_itself():
    rng = random.Random(6)
    value = key(rng)
    text = f"{prose(rng, 20)} bearer {value} {prose(rng, 5)} bearer {value} {prose(rng, 20)}"
    assert len(secrets.novel_spans(text, secrets.Novelty())) == 2


def test_keys_without_sensitive_words_are_left_alone():
    rng = random.Random(7)
    assert secrets.novel_spans(f"{prose(rng, 20)} {key(rng)} {prose(rng, 20)}", secrets.Novelty()) == []
    far = f"token {prose(rng, 30)} {key(rng)}"
    assert secrets.novel_spans(far, secrets.Novelty()) == []


def test_the_corpus_teaches_its_names(spark):
    name = "ZqvWkxJprTnbMhgQfd"
    assert secrets.novel_spans(f"token {name}", secrets.Novelty())
    rows = [(i, f"number {i} token is {name} in place {i}") for i in range(5)] + [(9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert name in secrets.corpus_words(docs)
    assert all(r.n_novel == 0 for r in secrets.scan(docs).collect())
    copies = spark.createDataFrame([(i, f"token is {name}") for i in range(50)], "doc_id long, text string")
    assert name not in secrets.corpus_words(copies)  # one place, however often it is copied


def test_planted_secrets_are_found_by_the_method(spark, sf_dir):
    """Of the spans that the hex pattern finds in the table, the method finds nine of ten by itself, and hardly anything else."""
    from nearfield.llm.common import table

    texts = [r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    novelty = secrets.Novelty(secrets.corpus_words(table(spark, "/root/testdata/sf0.01", "documents")))
    planted = [(t, s) for t in texts for s in secrets.base_spans(t) if s.kind == "hex"]
    found = [(t, n) for t in texts for n in secrets.novel_spans(t, novelty)]
    hit = lambda t, s, more: any(u is t and a.start < s.end and s.start < a.end for u, a in more)
    assert planted and sum(hit(t, s, found) for t, s in planted) >= 0.9 * len(planted)
    assert sum(hit(t, n, [(t, s) for s in secrets.base_spans(t)]) for t, n in found) >= 0.9 * len(found)
