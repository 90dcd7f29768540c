"""Reading articles with a user's client."""

import datetime

import pytest

from tidewire.plans.run import Settings
from tidewire.sources.articles import NOT_ALLOWED, read_articles


def test_articles_are_read_once_by_host_with_row_errors(spark, tmp_path):
    folder = str(tmp_path)
    links = [f"https://a.com/{i}" for i in range(8)] + ["https://a.com/1#part", "https://a.com/1?utm_source=x", "https://b.com/bad",
             "https://b.com/long", "https://c.com/x", "http://a.com/plain", "https://a.com/own"]
    rows = [(u, ["a.com", "b.com"], "inline" if u.endswith("own") else "article") for u in links]

    class Client:
        def __init__(self):
            self.log = open(f"{folder}/log", "a")  # noqa: SIM115

        def __call__(self, url):
            self.log.write(url + "\n")
            if url.endswith("bad"):
                raise OSError("gone")
            return b"x" * (200 if url.endswith("long") else 10)

        def close(self):
            self.log.close()

    items = spark.createDataFrame(rows, "url string, allowed_hosts array<string>, content_mode string")
    found = {r["article_url"]: r for r in read_articles(items, Client, clients_per_host=2, max_bytes=100).collect()}
    asked = sorted(line.strip() for line in open(f"{folder}/log"))
    assert asked == sorted([f"https://a.com/{i}" for i in range(8)] + ["https://b.com/bad", "https://b.com/long"])
    assert found["https://b.com/bad"]["error"] == "OSError: gone" and found["https://b.com/bad"]["body"] is None
    assert found["https://b.com/long"]["error"] == "article is too large"
    assert {u for u, r in found.items() if r["error"] == NOT_ALLOWED} == {"https://c.com/x", "http://a.com/plain"}
    assert bytes(found["https://a.com/3"]["body"]) == b"x" * 10 and len(found) == 12
    nothing = read_articles(items.limit(0), Client)
    assert nothing.count() == 0


def test_a_client_that_cannot_be_built_fails_its_rows(spark):
    items = spark.createDataFrame([("https://a.com/1", ["a.com"], "article")], "url string, allowed_hosts array<string>, content_mode string")

    def broken():
        raise RuntimeError("no client")

    (row,) = read_articles(items, broken).collect()
    assert row["error"] == "RuntimeError: no client"


def test_run_day_is_read_once_in_beijing():
    calls = []

    def clock():
        calls.append(1)
        return datetime.datetime(2026, 8, 11, 16, 30, tzinfo=datetime.UTC)

    assert Settings.now(clock, keywords=("a",)).run_date == datetime.date(2026, 8, 12) and len(calls) == 1
    with pytest.raises(ValueError, match="zone"):
        Settings.now(lambda: datetime.datetime(2026, 8, 11))
