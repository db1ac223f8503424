import random
import re

from folivane.operators import chunking


def brute(md, size, overlap):
    md = re.sub(r"(?<!\n)(#{1,6} [A-Z0-9])", r"\n\n\1", md)
    md = re.sub(r"(?<!\n)(```)", r"\n\1", md)
    out, head, body = [], "", []
    for line in [*md.splitlines(), None]:
        if line is None or line.lstrip()[:1] == "#":
            w = "\n".join(body).split()
            if len(w) >= 4:
                k = 0
                while True:
                    out.append((head, " ".join(w[k : k + size])))
                    if k + size >= len(w):
                        break
                    k += size - overlap
            body = []
            head = line.lstrip("#").strip() if line is not None else ""
        else:
            body.append(line)
    return out


def run(spark, texts, size=0, overlap=0):
    rows = chunking.chunk_pages(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string"), "k", "t", size, overlap).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.key, r.idx)):
        by.setdefault(r.key, []).append((r.heading, r.text))
    return [by.get(i, []) for i in range(len(texts))]


def test_quirks_and_edges(spark):
    w = lambda n: " ".join(f"w{i}" for i in range(n))
    texts = ["# A\n  ## B c\nx y z u", "```\n# in code\na b c d\n```", "# lower\na b c d", "#nospace\na b c", "one line # Heading two three four five", "", "# only"]
    texts += [w(n) for n in (3, 4, 700, 701, 1320, 1321)]
    assert run(spark, texts) == [brute(t, 700, 80) for t in texts]
    assert run(spark, [None]) == [[]]


def test_random(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["# H", "  ## In", "a b c", "d e f g h i j k", "", "x y z ```q", "k # Big end"]) for _ in range(rng.randint(0, 25))) for _ in range(60)]
    assert run(spark, texts, 10, 3) == [brute(t, 10, 3) for t in texts]
