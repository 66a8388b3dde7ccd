import random
import time

from keyreel.llm.quotes import linked


def rows(df):
    return [(r.conv_id, r.turn, r.clean_text, r.n_quotes, r.n_linked, r.parent_turn, [r.root_turn, r.depth]) for r in linked(df).collect()]


def test_tree_of_replies(spark):
    m = [
        (1, 0, "u", "Hello there.\nHow  are you?\n\nSecond part"),
        (1, 1, "a", "On Monday x wrote:\n> hello there. how ARE you?\n\nFine."),
        (1, 2, "u", "> Second part\nYes, second."),
        (1, 3, "a", "> > Hello there. How are you?\n> Fine.\nGood."),
        (1, 4, "u", "> never said\nOdd."),
        (1, 5, "a", ">> Fine.\n> Good.\n\nEnd"),
        (1, 6, "a", "plain"),
        (2, 0, "u", "> Fine.\nother conversation"),
        (2, 1, None, None),
        (2, 1, "x", ""),
        (None, 0, "u", "> a"),
        (3, None, "u", "b"),
    ]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, text string")
    got = {(c, t, x): r for c, t, x, *r in rows(df)}
    assert len(got) == len(m) - 1  # the two empty texts of (2, 1) are alike
    assert got[1, 1, "Fine."] == [1, 1, 0, [0, 1]]
    assert got[1, 2, "Yes, second."] == [1, 1, 0, [0, 1]]
    assert got[1, 3, "Good."] == [2, 2, 1, [0, 2]]
    assert got[1, 4, "Odd."] == [1, 0, None, [4, 0]]
    assert got[1, 5, "End"] == [2, 2, 3, [0, 3]]
    assert got[1, 6, "plain"] == [0, 0, None, [6, 0]]
    assert got[2, 0, "other conversation"] == [1, 0, None, [0, 0]]
    order = [r[1] for r in rows(df) if r[0] == 1]
    assert order == [0, 1, 2, 3, 5, 4, 6]


def test_long_chain_against_brute_force(spark):
    m = [(7, t, "u", (f"> word {t - 1}\n" if t else "") + f"word {t}") for t in range(70)]
    m += [(8, t, "u", "> same\nsame") for t in range(40)]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, text string")
    got = {(r[0], r[1]): r for r in rows(df)}
    for t in range(70):
        assert got[7, t][6] == [0, t] and got[7, t][5] == (t - 1 if t else None)
    for t in range(40):
        assert got[8, t][5] == (t - 1 if t else None) and got[8, t][2] == "same"


def test_trimmed_and_rewrapped_quotes(spark):
    m = [
        (1, 0, "u", "The first line of three\nthen the second line\nand the third one.\n\nOther words"),
        (1, 1, "a", "> the first LINE of three\n> then the second line\nTwo lines."),
        (1, 2, "u", "> The first line of three\n> and the third one.\nThe middle is cut."),
        (1, 3, "a", "> first line of three then\n> the second\n> line and\nRewrapped."),
        (1, 4, "u", "> > Two\n> nothing like this\n> and the third one.\nPart of a line, and a line unknown."),
        (1, 5, "a", "> the first line\n> of four\nNot held."),
        (1, 6, "u", "No other words here"),
        (1, 7, "a", "> Other words\nA whole line goes before a part of a later one."),
        (1, 8, "u", "> middle is cut.\n> then the second line\nIn two messages."),
        (2, 1, "u", "> then the second line\n> and the third one.\nother conversation"),
    ]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, text string")
    got = {r[:2]: r[3:] for r in rows(df)}
    for t in (1, 2, 3):
        assert got[1, t] == (1, 1, 0, [0, 1])
    assert got[1, 4] == (2, 1, 1, [0, 2])
    assert got[1, 7] == (1, 1, 0, [0, 1])
    for k in ((1, 5), (1, 8), (2, 1)):
        assert got[k] == (1, 0, None, [k[1], 0])


def parsed(text):
    """(level, body) of the lines, announcements apart: another way to say what the patterns say."""
    out = []
    for line in (text or "").replace("\r\n", "\n").split("\n"):
        level, i = 0, 0
        while True:
            j = i + 1 if line[i : i + 1] in (" ", "\t") and line[i + 1 : i + 2] == ">" and level == 0 else i
            if line[j : j + 1] != ">":
                break
            level, i = level + 1, j + 1
            if line[i : i + 1] in (" ", "\t"):
                i += 1
        out.append((level, line[i:]))
    return [x for k, x in enumerate(out) if not (x[0] == 0 and x[1].rstrip().endswith("wrote:") and k + 1 < len(out) and out[k + 1][0] > 0)]


def runs(lines):
    out, open_ = [], False
    for level, body in lines:
        if not body.strip():
            open_ = False
        elif open_ and out[-1][0] == level:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
            open_ = True
    return out


def words(text):
    return " ".join(text.lower().split())


def brute(messages):
    """turn -> (quotes, linked, parent, root, depth) of one conversation's messages, a text a turn."""
    known, out = {}, {}
    for turn, text in sorted(messages):
        lines = parsed(text)
        quotes = [r for r in runs(lines) if r[0] > 0]
        own = [x for x in lines if x[0] == 0]
        votes = []
        for level, body in quotes:
            whole = words("\n".join(body))
            holds = [t for t, (full, _) in known.items() if whole in full]
            if not holds:
                parts = {words(b) for b in body}
                holds = [t for t, (_, paragraphs) in known.items() if all(any(f" {x} " in f" {p} " for p in paragraphs) for x in parts)]
            if holds:
                votes.append((level, -max(holds)))
        parent = -min(votes)[1] if votes else None
        root, depth = (out[parent][3], out[parent][4] + 1) if votes else (turn, 0)
        out[turn] = (len(quotes), len(votes), parent, root, depth)
        paragraphs = [words("\n".join(b)) for _, b in runs(own)]
        known[turn] = ({*paragraphs, *(words(b) for _, b in own if b.strip())}, paragraphs)
    return out


def test_generated_conversations_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    sentence = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(2, 7)))
    rows = []
    for conv in range(60):
        texts = []
        for turn in range(rng.randint(2, 12)):
            parts = []
            for _ in range(rng.randint(0, 2) if texts else 0):
                old = rng.choice(texts).split("\n")
                a = rng.randrange(len(old))
                quote = old[a : a + rng.randint(1, 4)]
                if rng.random() < 0.2:
                    quote = [w for w in " ".join(quote).split("  ")]
                if rng.random() < 0.2:
                    quote = [q.upper() for q in quote]
                if rng.random() < 0.2:  # an edit: the passage is no one's
                    quote[0] += " " + rng.choice(vocabulary)
                if rng.random() < 0.4:
                    parts.append("Someone wrote:")
                parts += [rng.choice(["> ", ">", " > "]) + q for q in quote]
                parts += [""] * rng.randint(0, 1)
            for _ in range(rng.randint(1, 3)):
                parts += [sentence() for _ in range(rng.randint(1, 3))] + [""] * rng.randint(0, 1)
            texts.append("\n".join(parts))
            rows.append((conv, turn, "u", texts[-1]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.parent_turn, r.root_turn, r.depth) for r in linked(df).collect()}
    want = {}
    for conv in range(60):
        want |= {(conv, t): r for t, r in brute([(t, x) for c, t, _, x in rows if c == conv]).items()}
    assert got == want
    assert sum(r[1] for r in want.values()) > 150 and max(r[0] for r in want.values()) >= 3


def test_time_grows_with_the_length_of_a_text(spark):
    def took(n):
        text = "".join(f"someone wrote:\n> quoted line {i}\nline {i}\n\n" for i in range(n))
        df = spark.createDataFrame([(1, 0, "u", "quoted line 5"), (1, 1, "u", text)], "conv_id long, turn long, role string, text string")
        began = time.perf_counter()
        got = {r.turn: r for r in linked(df).collect()}
        assert (got[1].n_quotes, got[1].n_linked, got[1].parent_turn) == (n, 1, 0)
        return time.perf_counter() - began

    took(100)
    small, large = took(5_000), took(40_000)
    assert large < 10 * small + 5


def test_empty(spark):
    assert linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
