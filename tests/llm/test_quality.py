import re

from tessera.llm.quality import LineLimits, line_quality, repeated_words


def brute(rows, limits):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    norm = lambda s: " ".join(words(re.sub("[0-9]", "0", "".join(c.lower() if c < "\x80" else c for c in s))))
    docs = {(i, h, t) for i, t, h in rows}
    n, have = {}, {}
    for _, h, t in docs:
        n[h] = n.get(h, 0) + 1
        for k in {norm(s) for s in (t or "").split("\n") if words(s)}:
            have[h, k] = have.get((h, k), 0) + 1
    out = []
    for i, t, h in rows:
        w = words(t or "")
        lines = [s for s in (t or "").split("\n") if words(s)]
        cover = set()
        win = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        for j, x in enumerate(win):
            if win.count(x) > 1:
                cover |= {j, j + 1, j + 2}
        left = sum(len(words(s)) for s in lines if not (have[h, norm(s)] >= limits.documents and have[h, norm(s)] >= limits.share * n[h]))
        failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), failed, not failed and left >= limits.left * len(w) and left >= limits.words, left))
    return sorted(out, key=str)


def test_against_brute_force(spark, documents):
    boiler = "Share this page 12\nRead more about our terms of use and privacy rules here today friends"
    rows = [(r.doc_id, r.text, r.source) for r in documents.where("length(text) < 1000 or text is null").collect()]
    rows += [(100 + i, f"{boiler.replace('12', str(i))}\n" + " ".join(f"w{i}x{j}" for j in range(60)), "src0" if i % 2 else None) for i in range(8)]
    rows += [(200 + i, "\n".join(f"common line number {chr(97 + j)} with some more words in it" for j in range(9)), "src1") for i in range(5)]
    rows += [rows[-1], (300, "alone " + " ".join(f"u{j}" for j in range(60)), "src1")]
    limits = LineLimits(documents=3, share=0.1, left=0.5, words=20)
    got = line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), limits).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, limits)


def test_long_texts_and_empty(documents, nothing):
    got = {r.doc_id: r for r in line_quality(documents).where("doc_id in (9, 10)").collect()}
    assert got[9].n_words == 1 and got[10].n_words == 3000 and got[10].n_repeat_words == 3000 and got[10].base_failed
    assert line_quality(nothing).count() == 0


def test_repeated_words():
    assert repeated_words("a b c a b c".split()) == 6 and repeated_words("a a a a".split()) == 4 and repeated_words("a b c d".split()) == 0
