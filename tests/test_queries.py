from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from quillsift.operators import chunking
from quillsift.plans import queries, search
from quillsift.plans.queries import ORACLES, QUERIES
from tests.oracle import same
from tests.test_lexical import brute_search


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 20


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, data, name):
    same(spark, data, QUERIES[name], ORACLES[name])


def test_queries_without_sql_are_those_below():
    assert set(QUERIES) - set(ORACLES) == {"rate_limit", "token_budget", "word_chunks", "similar_documents", "lexical_english"}


def test_lexical_english_equals_brute_force(spark, data):
    docs = {r.doc_id: ("t", [(r.text, 0.1)]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    asked = {r.item_id: ("t", r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()}
    rows = QUERIES["lexical_english"](spark, data).collect()
    assert rows and {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in rows} == brute_search(asked, docs, 20, True)
    assert all(0 < r.zones_read <= r.zones for r in rows)


def events_of(spark, data):
    rows = [(r.user_id, r.ts.timestamp(), r.event_id, r.event_type, r.value) for r in spark.read.parquet(f"{data}/events.parquet").collect()]
    return sorted(rows, key=lambda r: (r[0], r[1], r[2]))


def test_rate_limit_equals_brute_force(spark, data):
    taken, expected = defaultdict(list), {}
    for user, at, event, *_ in events_of(spark, data):
        ok = sum(t > at - 86_400 for t in taken[user]) < 5
        taken[user] += [at] * ok
        expected[event] = ok
    got = {r.event_id: r.accepted for r in QUERIES["rate_limit"](spark, data).collect()}
    assert got == expected and not all(expected.values())


def test_token_budget_equals_brute_force(spark, data):
    """Three budgets asked in turn: what an earlier one has taken stays taken."""
    taken, expected = defaultdict(lambda: ([], [], [])), {}
    for user, at, event, kind, value in sorted(events_of(spark, data), key=lambda r: (r[1], r[2])):
        key, tokens, ok = (kind, user % 10), max(1, int(value)), True
        for held, n, most, seconds in zip(taken[key], (tokens, 1, 1), (120, 2, 50), (60, 60, 86_400), strict=True):
            if sum(m for t, m in held if t > at - seconds) + n > most:
                ok = False
                break
            held.append((at, n))
        expected[event] = ok
    got = {r.tie: r.accepted for r in QUERIES["token_budget"](spark, data).collect()}
    assert got == expected and not all(expected.values())


def brute_split(text, most, start):
    """Sentences put together while they fit."""
    if len(text.split()) <= most:
        return [(text.strip(), start)] if text.strip() else []
    out, held = [], []
    for sentence in re.split(r"(?<=[.!?])\s+", text) + [None]:
        words = [] if sentence is None else sentence.split()
        if held and (sentence is None or len(held) + len(words) > most):
            out.append(" ".join(held))
            held = []
        held += words
    places = [start]
    for content in out:
        places.append(places[-1] + len(content) + 1)
    return list(zip(out, places, strict=False))


def brute_sections(text):
    """(label, body, start): lines by the number of headings so far; a heading counts unless the line before counts, or there is none."""
    lines, counts, groups, at = text.split("\n"), [], defaultdict(list), 0
    for k, line in enumerate(lines):
        counts.append(bool(k and not counts[-1] and chunking.heading(line)))
        groups[sum(counts)].append((at, line))
        at += len(line) + 1
    found = []
    for k, rows in groups.items():
        label, body = (chunking.heading(rows[0][1]), rows[1:]) if k else ("summary", rows)
        found.append((label, "\n".join(line for _, line in body).strip(), rows[0][0]))
    return [x for x in found if x[1]] or [("other", text.strip(), 0)]


def test_word_chunks_equal_brute_force(spark, data):
    """Parents of 700 words in each section, children of 180 in each parent."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = defaultdict(list)
    for r in QUERIES["word_chunks"](spark, data).orderBy("document_id", "chunk_index").collect():
        got[r.document_id].append((r.is_parent, r.start_char, r.end_char, r.token_count, r.section))
    sections = 0
    for k, text in texts.items():
        expected = []
        for label, body, begin in brute_sections(text) if text.strip() else []:
            sections += 1
            for parent, at in brute_split(body, 700, begin):
                children = brute_split(parent, 180, at)
                for content, start, is_parent in [(parent, at, True), *((c, s, False) for c, s in children)]:
                    expected.append((is_parent, start, start + len(content), max(1, round(len(content.split()) * 1.33)), label))
        assert got[k] == expected, k
    assert sections >= len(texts)


def test_similar_documents_equal_brute_force(spark, data):
    versions = queries._versions(spark, data).withColumn("tenant_id", queries.F.lit("t"))
    rows = [r for r in search.index_versions(versions).orderBy("document_id", "chunk_index").collect() if not r.is_parent]

    def vector(text):
        raw = np.array([(b - 128) / 128 for b in hashlib.sha256(text.encode()).digest()] * 2)
        return raw / np.linalg.norm(raw)

    matrix = np.stack([np.float32(vector(r.content)) for r in rows]).astype(float)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    texts = defaultdict(list)
    for r in rows:
        texts[r.document_id].append(r.content)
    expected = {}
    for k, chunks in texts.items():
        if k % 20:
            continue
        scores = np.round(matrix @ vector(" ".join(chunks[:5])[:2000].strip()), 12)
        top = sorted(range(len(rows)), key=lambda i: (-scores[i], rows[i].chunk_id))[:40]
        best = defaultdict(list)
        for i in top:
            if rows[i].document_id != k:
                best[rows[i].document_id].append(scores[i])
        sums = sorted(((round(sum(sorted(s)[::-1][:5]), 9), d) for d, s in best.items()), key=lambda x: (-x[0], x[1]))[:10]
        expected |= {(k, n + 1): (d, round(s, 6)) for n, (s, d) in enumerate(sums)}
    got = {(r.query_id, r.rank): (r.document_id, r.score) for r in QUERIES["similar_documents"](spark, data).collect()}
    assert got.keys() == expected.keys() and len(got) > 90
    assert all(got[k][0] == expected[k][0] and got[k][1] == pytest.approx(expected[k][1], abs=2e-6) for k in got)
