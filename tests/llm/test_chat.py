from collections import defaultdict

from netweir.llm import chat as C


def brute(turns):
    convs = defaultdict(list)
    for conv, turn, who, text in turns:
        convs[conv].append((turn, who, text or ""))
    out = {}
    for conv, ts in convs.items():
        ts.sort(key=lambda t: (t[0] is not None, t[0] or 0))
        for me in {t[1] for t in ts}:
            text, masks = "", []
            for _, who, body in ts:
                text += "<|assistant|>\n" if who == me else f"<|user:{'unknown' if who is None else who}|>\n"
                start = len(text)
                text += body + C.END
                if who == me:
                    masks.append((start, len(text)))
            out[conv, me] = text, masks
    return out


def joined(rows):
    out = defaultdict(lambda: ["", []])
    for r in sorted(rows, key=lambda r: r.piece):
        entry = out[r.conv_id, r.perspective]
        assert r.begin == len(entry[0]) and r.n_masked == sum(m.end - m.start for m in r.masks)
        entry[0] += r.rendered
        entry[1] += [(m.start, m.end) for m in r.masks]
    return {k: tuple(v) for k, v in out.items()}


def test_against_brute_force(spark):
    turns = [(1, 0, "ann", "hi"), (1, 1, "bob", "hé\nllo"), (1, 2, "cy", None), (1, 3, "ann", ""), (2, None, None, "x"), (2, 5, "ann", "y" * 9000),
             (None, 1, "ann", "q"), (None, 0, "bob", "r")] + [(3, i, "ann" if i % 3 else "bob", "t%d" % i) for i in range(50)]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, piece string")
    for piece in (64, 8):
        assert joined(C.perspectives(frame, piece=piece).collect()) == brute(turns)
    assert C.perspectives(frame.limit(0)).count() == 0


def test_repeated_turns_are_kept(spark):
    frame = spark.createDataFrame([(1, 0, "ann", "hi")] * 5 + [(1, 0, "bob", "yo")] * 5, "conv_id long, turn long, role string, text string")
    rows = C.perspectives(frame, piece=4).collect()
    assert sum(r.n_turns for r in rows) == 20 and sum(r.n_own_turns for r in rows) == 10
    assert max(r.n_turns for r in rows) == 4
