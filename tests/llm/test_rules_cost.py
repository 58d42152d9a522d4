"""op6's line rules take plain passes: no character-wise translation of a line or a text."""

from vaultql.llm import rules

TEXT = "A B\nHOME\nAll Rights RESERVED © x.\n#a $b.\nMENÜ\nmenü\n\x0b\n x."


def test_no_translation(spark):
    out = rules.clean_lines(spark.createDataFrame([(TEXT,)], "text string"))
    assert "translate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    r = out.first()
    assert r.word_chars == sum(map(len, TEXT.split()))
    assert (r.n_symbols, r.n_lines, r.n_bad_lines, r.clean_text) == (2, 7, 6, "\x0b\n x.")
