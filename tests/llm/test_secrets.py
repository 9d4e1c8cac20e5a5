"""What the field adds to the fixed patterns, on texts it has not seen."""
import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pricematch.llm import secret_scan

FORMS = {  # form, characters of the secret: the least share of planted ones that is found
    ("client_secret = {}", "hex12"): 0.85, ("aws_secret_access_key = {}", "b64_40"): 0.9, ("Authorization: Bearer {}", "b64_40"): 0.9,
    ("key {}", "hex20"): 0.9, ('"private_key": "{}"', "b64_24"): 0.9, ("see {} there", "b64_40"): 0.9, ("auth {}", "b32_20"): 0.9,
    ("passphrase={}", "b64_14"): 0.3,
}
PLAIN = [
    "token = expired", "the password: none", "secret = 42", "count = 1200", "path: /usr/lib/python3/dist-packages/x.py", "api_key: not-set",
    "see https://example.com/a/b/c-d?x=1", "version 1.2.3-rc1", "ISBN 9780306406157", "a state-of-the-art key", "2024-01-15T12:00:00",
    "IMG_20240115_1200.jpg", "0123-4567-8901", "commit 3f2a9c1", "e-mail to john.smith1978@mail.example.com", "key 12345678",
]


def secret(rng, kind):
    digest = hashlib.sha256(str(rng.random()).encode()).digest()
    coded = base64.b64encode(digest).decode()
    return {"hex12": digest.hex()[:12], "hex20": digest.hex()[:20], "b64_14": "".join(filter(str.isalnum, coded))[:14],
            "b64_24": coded[:24], "b64_40": coded[:40], "b32_20": base64.b32encode(digest).decode()[:20]}[kind]


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").filter("text is not null")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    return secret_scan.fit(docs.filter(third != 1)), [r.text for r in docs.filter(third == 1).orderBy("doc_id").collect()]


def test_recall_on_planted_secrets(learned):
    """Secrets in forms that no base pattern finds, put between the words of held-out texts."""
    model, texts = learned
    rng = random.Random(1)
    texts = [t for t in texts if len(t.split(" ")) > 30][:120]
    for (form, kind), least in FORMS.items():
        found = 0
        for text in texts:
            words, said = text.split(" "), secret(rng, kind)
            at = rng.randrange(len(words))
            before = " ".join(words[:at]) + " "
            whole = before + form.format(said) + " " + " ".join(words[at:])
            a = len(before) + form.index("{}")
            found += any(x <= a + 1 and y >= a + len(said) - 1 for x, y in secret_scan.crf_spans(model, whole))
        assert found >= least * len(texts), (form, kind, found, len(texts))


def test_precision_on_texts_without_planted_ones(learned):
    model, texts = learned
    marked = 0
    for text in texts:
        base = secret_scan.base_spans(text.encode(), text)
        marked += sum(not any(x <= a and b <= y for x, _, y, _ in base) for a, b in secret_scan.crf_spans(model, text))
    assert marked * 200 <= len(texts)
    for line in PLAIN:
        assert not secret_scan.crf_spans(model, f"some plain words before {line} and others after")


def test_base_spans_of_held_out_texts_are_found_by_the_field_too(learned):
    model, texts = learned
    values = [(t, v, e) for t in texts for _, kind, e, v in secret_scan.base_spans(t.encode(), t)]
    found = sum(any(a <= v + 1 and b >= e - 1 for a, b in secret_scan.crf_spans(model, t)) for t, v, e in values)
    assert values and found >= 0.8 * len(values)
