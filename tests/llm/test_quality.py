from lectern.llm import quality


def test_capitals_are_counted_over_whole_texts():
    for line, length in (("Abcdefg\n", 24_000), ("abcdefghijK\n", 14_168), ("É über Ä\n", 30_000), ("", 0), ("aB", 2)):
        text = (line * (1 + length // max(1, len(line))))[:length]
        share = sum(c.isupper() for c in text) / max(1, len(text))
        assert quality.capitals(text) == sum(c.isupper() for c in text)
        assert abs(quality.metadata(None, None, text)[4] - min(3.0, 5 * share)) < 1e-12
