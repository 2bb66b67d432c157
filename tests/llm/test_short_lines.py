from sumiveil.llm.substrings import dedup_substrings


def test_short_whole_lines_go(spark):
    rows = [
        (1, "Read more about this\nfirst text of its own kind here"),
        (2, "second one has other words\nread more about this.\nand then it ends"),
        (3, "we read more about this\nMore\nsurely different again"),  # as a piece of a line it stays
        (4, "fourth\nnine words stand in this line of the text\nend of four"),
        (5, "fifth\nnine words stand in this line of the text\nend of five\nfifth"),
        (6, "Read more about this"),  # all of a text
        (7, "about this\nmore"),  # no text has "about this" as a line before
    ]
    texts = dict(rows)
    got = {r["doc_id"]: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    expected = dict(texts) | {2: "second one has other words\nand then it ends", 5: "fifth\nend of five\n", 6: "", 7: "about this\n"}
    assert {i: r["text"] for i, r in got.items()} == expected
    for i, r in got.items():
        cut = texts[i]
        for s in reversed(r["spans"]):
            cut = cut[: s["start"]] + cut[s["end"] :]
        assert cut == r["text"] and len(texts[i]) - len(cut) == r["n_removed"]
