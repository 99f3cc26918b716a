"""What op7 knows of a token, against its definition by patterns."""

import xxhash

from loomrank.llm import decontamination as d

ODD = ["plain", "Name", "Name.", "end!", "word,", "word)", "(word)", "\"Quoted.\"", "quote.'", "it's", "__x__", "--", "...", ".", "!", "12", "$1,200.50", "5%", "-3.", "km", "KM.", "seconds,", "a1b2", "ÉTÉ?", "ß", "ſ", "İ.", "ǅa", "中文", "中文。", "٣", "x²", "\ud800", "a\ud800.", "é", "é.", "ª", "Ⅳ"]


def known_by_patterns(raw):
    bare = d.EDGE.sub("", raw)
    low = bare.lower()
    kind = d.NUMBER if d.NUMERIC.fullmatch(raw.rstrip(".,;:!?)\"'")) else d.UNIT if low in d.UNITS else d.NAME if bare[:1].isupper() else d.PLAIN
    return xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) | 8, kind, raw.rstrip("\"')").endswith((".", "!", "?")), low


def test_tokens_are_known_as_the_patterns_say_and_words_without_running_them(monkeypatch):
    words, run = d.Words(), []
    for part in (ODD[:10], ODD[10:], [f"w{i}" for i in range(500)]):
        at = [words[x] for x in part]
        words.learn()
        assert [(int(words.code[i]), words.kind[i], words.ends[i], words.bare(i)) for i in at] == [known_by_patterns(x) for x in part]
    pattern = d.EDGE
    monkeypatch.setattr(d, "EDGE", type("Counted", (), {"sub": lambda self, by, raw: (run.append(raw), pattern.sub(by, raw))[1]})())
    list(d.windows("Unseen wordsonly stand inhere, untilthe last oneis 1x0 reached.", [3], []))
    assert run == [x for x in run if x == "1x0"]
