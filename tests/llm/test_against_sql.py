"""Queries against their SQL: on the smallest tables, on tables of odd rows, and on empty tables."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import SMALL, rows_of

from loomwright.llm import registry

DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
BENCHMARK = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
CONVERSATIONS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
SCHEMAS = {"documents": DOCUMENTS, "benchmark": BENCHMARK, "labels": LABELS, "pages": PAGES, "conversations": CONVERSATIONS}

#: Driver-side SQL is slow at these; the smallest tables and the odd rows are enough.
NAMES = list(registry.SQL)


def odd_texts():
    rng = random.Random(5)
    words = [f"w{n}" for n in range(400)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    base, passage, item = prose(120), prose(60), prose(14)
    near = list(base)
    near[60] = "changed"
    upper = " ".join(base).upper()
    long = prose(6_000)
    return [
        None, "", " \t\n\x0b\x0c\r ", "one", "one two three", "ONE two three", " ".join(base), " ".join(base), " ".join(near), upper,
        "\n".join(base[:60]) + "\t" + "\x0b".join(base[60:]), " ".join(prose(80) + passage + prose(30)), " ".join(passage + prose(40)), " ".join(prose(10) + passage), " ".join(long), " ".join(long[:3_000] + passage + long[3_000:]),
        " ".join(prose(20) + item + prose(20)), "-".join(item), "short item", "Grüße Ünïcode\u00a0ß 日本 日本", "a b a b a b a b a b", "x\x1cy\x1fz " * 60, "line\nline\nline\n" * 30, "<|im_end|> #$%&*|<>", "word " * 300,
    ], item


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    texts, item = odd_texts()
    rows = [{"doc_id": n * 7 % 101, "text": t, "lang": [None, "en", "de"][n % 3], "source": [None, "src0", "src1", "src2"][n % 4], "n_chars": len(t or "")} for n, t in enumerate(texts)]
    write(folder, "documents", rows)
    write(folder, "benchmark", [{"item_id": 1, "text": " ".join(item)}, {"item_id": 2, "text": "short ITEM"}, {"item_id": 10, "text": " ".join(item[:12])}, {"item_id": 3, "text": None}, {"item_id": 4, "text": "--"}, {"item_id": 2, "text": "one"}, {"item_id": 5, "text": "日本"}])
    write(folder, "labels", [{"doc_id": n, "quality": [0, 1, None][n % 3], "toxic": None} for n in range(30)])
    urls = [None, "", "no scheme", "http://", "http://Example.ORG/es/a", "https://a.b.example.org/en/17?q=/es/", "http://notexample.org/es/x", "http://org", "http://x.com/de/", "http://x.com/dex", "http://COM/fr/#a", "http://u@x.com:80/de/1", "a://b://c/d", "http://example.org/en/1", "http://x.com/DE/1", "//x.com/de/1", "http://x.com?/de/"]
    write(folder, "pages", [{"page_id": n, "url": u, "html": None} for n, u in enumerate(urls)])
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\n"), (1, 1, "assistant", None), (2, 0, None, "<\\|im_end|>"), (2, 1, "a%b\n", "<\\\\|"), (2, 2, "assistant", "ünï 日本"), (3, 0, "system", ""), (None, 0, "user", "lost"), (None, 1, "assistant", "too"), (4, 0, "assistant", "x" * 50_000)]
    write(folder, "conversations", [dict(zip(CONVERSATIONS.names, t)) for t in turns])
    return folder


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name in SCHEMAS:
        write(folder, name, [])
    return folder


def write(folder, name, rows):
    pq.write_table(pa.Table.from_pylist(rows, SCHEMAS[name]), folder / f"{name}.parquet")


@pytest.mark.parametrize("name", NAMES)
def test_smallest_tables(name, same):
    assert same(registry.QUERIES[name], registry.SQL[name], SMALL) > 0


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(name, same, odd):
    assert same(registry.QUERIES[name], registry.SQL[name], odd) > 0


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(name, spark, empty):
    rows = rows_of(registry.QUERIES[name](spark, str(empty)))[1]
    assert len(rows) == (name == "op1_chat_format")  # the query adds one conversation


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_odd_rows_without_sql(name, spark, odd):
    rows = registry.QUERIES[name](spark, str(odd)).collect()
    assert name == "op5_secret_scan" or len(rows) == len(odd_texts()[0])
