"""Strict validation of responses, the ordered pass and its inserts, against plain Python."""

import json
import random

import pytest

from lectern.operators import extraction as X

PARA = [(b, c, 1000 * b + 10 * c + k) for b in (1, 2) for c in range(5) for k in range(3)]
MARKDOWN = "---\nbook_id: 1\nchapter_idx: 2\nchapter_label: Two\npart_label: \n---\n## Events\nx\n## State changes\n## Open questions\n"


def entity(**changes):
    e = {"designator": "Vixen", "node_kind": "named", "cite_para_id": 1020, "attributes": [{"attr_kind": "role", "value": "guide", "cite_para_id": 1021}], "aliases": [{"other_designator": "Red", "edge_type": "stated", "cite_para_id": 1022}]}
    return {k: v for k, v in (e | changes).items() if v is not ...}


def response(*entities, markdown=MARKDOWN, **changes):
    return json.dumps({k: v for k, v in ({"digest_markdown": markdown, "entities": list(entities)} | changes).items() if v is not ...})


def attribute(**changes):
    return entity(attributes=[{k: v for k, v in ({"attr_kind": "role", "value": "v", "cite_para_id": 1020} | changes).items() if v is not ...}])


def alias(**changes):
    return entity(aliases=[{"other_designator": "Red", "edge_type": "stated", "cite_para_id": 1020}, {k: v for k, v in ({"other_designator": "Red", "edge_type": "stated", "cite_para_id": 1020} | changes).items() if v is not ...}])


GOOD = response(entity())
CASES = [
    (GOOD, None),
    (response(), None),
    (response(entity(attributes=..., aliases=...)), None),
    (response(entity(attributes=[], aliases=[])), None),
    (f"```json\n{GOOD}\n```", None),
    (f" ```\n{GOOD}```  \n", None),
    (GOOD.replace("\\n", "\n"), None),
    (response(entity(), extra={"x": [1]}), None),
    (f"```json\n{GOOD}", "not JSON"),
    ("not json", "not JSON"),
    ("", "not JSON"),
    (None, "not JSON"),
    (GOOD + " and more", "not JSON"),
    (GOOD + "}", "not JSON"),
    (GOOD + "]", "not JSON"),
    (GOOD + ", 5", "not JSON"),
    ("[1, 2]", "not an object"),
    ("5", "not an object"),
    ("null", "not an object"),
    (response(digest_markdown=...), "digest_markdown: no text"),
    (response(markdown=7), "digest_markdown: no text"),
    (response(markdown=" \n"), "digest_markdown: no text"),
    (response(markdown=MARKDOWN.replace("## State changes", "## State")), "digest_markdown: no section ## State changes"),
    (response(markdown=MARKDOWN.replace("---", "--")), "digest_markdown: no front matter"),
    (response(markdown=MARKDOWN.replace("part_label: \n", "")), "digest_markdown: other front matter keys"),
    (response(markdown=MARKDOWN.replace("part_label", "mood: dark\npart_label")), "digest_markdown: other front matter keys"),
    (response(entities=...), "entities: no list"),
    (response(entities={}), "entities: no list"),
    (response(entity(), 5), "entities[1]: not an object"),
    (response(entity(), None), "entities[1]: not an object"),
    (response(entity(designator=...)), "entities[0].designator: no text"),
    (response(entity(designator=5)), "entities[0].designator: no text"),
    (response(entity(designator="  ")), "entities[0].designator: no text"),
    (response(entity(node_kind="robot")), "entities[0].node_kind: unknown"),
    (response(entity(node_kind=None)), "entities[0].node_kind: no text"),
    (response(entity(cite_para_id="1020")), "entities[0].cite_para_id: no integer"),
    (response(entity(cite_para_id=True)), "entities[0].cite_para_id: no integer"),
    (response(entity(cite_para_id=1020.0)), "entities[0].cite_para_id: no integer"),
    (response(entity(cite_para_id=1030)), "entities[0].cite_para_id: of another chapter"),
    (response(entity(), entity(cite_para_id=2020)), "entities[1].cite_para_id: of another chapter"),
    (response(entity(attributes=5)), "entities[0].attributes: no list"),
    (response(attribute(value=...)), "entities[0].attributes[0].value: no text"),
    (response(attribute(attr_kind=3)), "entities[0].attributes[0].attr_kind: no text"),
    (response(attribute(cite_para_id=9)), "entities[0].attributes[0].cite_para_id: of another chapter"),
    (response(entity(attributes=["x"])), "entities[0].attributes[0]: not an object"),
    (response(alias(edge_type="maybe")), "entities[0].aliases[1].edge_type: unknown"),
    (response(alias(other_designator="")), "entities[0].aliases[1].other_designator: no text"),
    (response(alias(cite_para_id=...)), "entities[0].aliases[1].cite_para_id: no integer"),
    (response(alias(cite_para_id=1)), "entities[0].aliases[1].cite_para_id: of another chapter"),
    (response(attribute(cite_para_id=9), entity(node_kind="robot")), "entities[0].attributes[0].cite_para_id: of another chapter"),
    (response(entity(node_kind="robot"), attribute(cite_para_id=9)), "entities[0].node_kind: unknown"),
]


def test_one_fault_with_its_place(spark):
    rows = [(1, 2, i, text) for i, (text, _) in enumerate(CASES)]
    checked = X.validated(spark.createDataFrame(rows, "book_id long, chapter_idx long, attempt int, response string"), spark.createDataFrame(PARA, "book_id long, chapter_idx long, para_id long"))
    got = {r["attempt"]: r for r in checked.collect()}
    for i, (text, error) in enumerate(CASES):
        assert got[i]["error"] == error, text
        assert (got[i]["entities"] is None) == (got[i]["digest_markdown"] is None) == (error is not None)
    one = got[0]["entities"][0]
    assert (one["designator"], one["attributes"][0]["value"], one["aliases"][0]["other_designator"]) == ("Vixen", "guide", "Red")
    assert got[6]["digest_markdown"] == MARKDOWN


def test_rollups(spark):
    text = MARKDOWN.replace("chapter_idx: 2\nchapter_label: Two\npart_label: ", "level: part\ntarget_label: One")
    rows = [(1, json.dumps({"digest_markdown": text})), (2, json.dumps({"digest_markdown": MARKDOWN})), (3, "{"), (4, "{}")]
    got = dict(X.rollup_errors(spark.createDataFrame(rows, "n int, response string")).select("n", "error").collect())
    assert got == {1: None, 2: "digest_markdown: other front matter keys", 3: "not JSON", 4: "digest_markdown: no text"}


def sequential(chapters, responses, nodes, edges, attrs, done, para):
    """The pass chapter by chapter, with tables changed in place."""
    anchor = {p: (b, c) for b, c, p in para}
    nodes, edges, attrs = list(nodes), list(edges), list(attrs)
    status, next_id = {}, max([n[0] for n in nodes], default=0) + 1
    for book in sorted({c[0] for c in chapters}):
        stopped = False
        for _, idx, start, end, kind in sorted((c for c in chapters if c[0] == book), key=lambda c: c[2]):
            if kind == "excerpt":
                continue
            if stopped or done.get((book, idx)) == "now":
                status[book, idx] = ("not reached" if stopped else "skipped", None)
                continue
            dead = {n[0] for n in nodes if (book, idx) in done and anchor.get(n[5]) == (book, idx)}
            for attempt in (1, 2):
                entities = responses.get((book, idx, attempt))
                if entities is None:
                    continue
                known = {n[2]: n[0] for n in nodes if n[1] == book and n[0] not in dead}
                names = known.keys() | {e["designator"] for e in entities}
                if any(a["other_designator"] not in names for e in entities for a in e["aliases"]):
                    continue
                nodes = [n for n in nodes if n[0] not in dead]
                edges = [e for e in edges if e[0] not in dead and e[1] not in dead]
                attrs = [a for a in attrs if a[0] not in dead]
                for e in entities:
                    if e["designator"] not in known:
                        known[e["designator"]] = next_id
                        nodes.append((next_id, book, e["designator"], e["node_kind"], end, e["cite_para_id"]))
                        next_id += 1
                for e in entities:
                    attrs += [(known[e["designator"]], a["attr_kind"], a["value"], end, a["cite_para_id"]) for a in e["attributes"]]
                    edges += [(known[e["designator"]], known[a["other_designator"]], a["edge_type"], end, a["cite_para_id"]) for a in e["aliases"]]
                status[book, idx] = ("done", attempt)
                break
            else:
                status[book, idx], stopped = ("failed", None), True
    return status, nodes, edges, attrs


@pytest.mark.parametrize("seed", range(4))
def test_pass_is_sequential(spark, seed):
    rng = random.Random(seed)
    para = [(b, c, 1000 * b + 10 * c + k) for b in range(1, 9) for c in range(7) for k in range(3)]
    chapters = [(b, c, 1000 * b + 10 * c, 1000 * b + 10 * c + 2, "excerpt" if rng.random() < 0.1 else "body") for b in range(1, 9) for c in range(7)]
    names = ["A", "B", "C", "D", "E"]
    texts, plain = [], {}
    for b, c, start, _, _ in chapters:
        for attempt in (1, 2):
            if rng.random() < 0.05:
                continue
            es = [
                {
                    "designator": rng.choice(names), "node_kind": "named", "cite_para_id": start + rng.randrange(3),
                    "attributes": [{"attr_kind": "k", "value": f"{c}{attempt}{k}", "cite_para_id": start} for k in range(rng.randrange(2))],
                    "aliases": [{"other_designator": rng.choice(names if rng.random() < 0.1 else ["A", "B"]), "edge_type": "stated", "cite_para_id": start} for _ in range(rng.randrange(2) if c else 0)],
                }
                for _ in range(rng.randrange(1, 4))
            ]
            if not c:
                es += [{"designator": n, "node_kind": "unnamed", "cite_para_id": start, "attributes": [], "aliases": []} for n in "AB"]
            good = rng.random() < 0.65
            texts.append((b, c, attempt, response(*es) if good else response(*es)[:-4]))
            if good:
                plain[b, c, attempt] = es
    nodes = [(10 + i, b, n, "named", 1, 1000 * b + 10 * rng.randrange(7)) for i, (b, n) in enumerate((b, n) for b in (1, 2, 3, 4) for n in "ABCD")]
    edges = [(10 + 4 * k, 11 + 4 * k, "stated", 1, 1000) for k in range(4)]
    attrs = [(10 + k, "old", "v", 1, 1000) for k in range(16)]
    done = {(b, c): rng.choice(["now", "old", "old"]) for b in range(1, 9) for c in range(7) if rng.random() < 0.4}
    frame = spark.createDataFrame
    chapter = frame(chapters, "book_id long, chapter_idx long, start_seq long, end_seq long, kind string")
    paras = frame(para, "book_id long, chapter_idx long, para_id long")
    node_df = frame(nodes, "node_id long, book_id long, designator string, node_kind string, first_seq long, cite_para_id long")
    done_df = frame([(*k, v, 2) for k, v in done.items()], "book_id long, chapter_idx long, prompt_hash string, schema_version int")
    checked = X.validated(frame(texts, "book_id long, chapter_idx long, attempt int, response string"), paras)
    registry = node_df.join(paras.selectExpr("book_id", "para_id as cite_para_id", "chapter_idx"), ["book_id", "cite_para_id"])
    passed = X.chapter_pass(chapter, checked, registry, done_df, "now", 2)
    status, *want = sequential(chapters, plain, nodes, edges, attrs, done, para)
    assert {(r["book_id"], r["chapter_idx"]): (r["status"], r["attempt"]) for r in passed.collect()} == status
    assert {"done", "skipped", "failed", "not reached"} >= {s for s, _ in status.values()} and len(set(status.values())) > 2
    made = X.insert_entities(chapter, checked, passed, node_df, frame(edges, "src_node_id long, dst_node_id long, edge_type string, revealed_at_seq long, cite_para_id long"), frame(attrs, "node_id long, attr_kind string, value string, first_seq long, cite_para_id long"), paras, done_df)
    for df, rows in zip(made, want, strict=True):
        assert sorted(map(tuple, df.collect())) == sorted(rows)


def test_nothing_to_do(spark):
    frame = spark.createDataFrame
    chapter = frame([(1, 0, 0, 2, "body")], "book_id long, chapter_idx long, start_seq long, end_seq long, kind string")
    none = X.validated(frame([], "book_id long, chapter_idx long, attempt int, response string"), frame([], "book_id long, chapter_idx long, para_id long"))
    assert none.collect() == []
    passed = X.chapter_pass(chapter, none, frame([], "book_id long, designator string, chapter_idx long"), frame([], "book_id long, chapter_idx long, prompt_hash string, schema_version int"), "now", 2)
    assert [(r["status"], r["error"], r["calls"]) for r in passed.collect()] == [("failed", "no response", 0)]
