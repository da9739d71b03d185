"""The template search against plain loops over all windows of a small corpus."""

import random
from collections import defaultdict

from labelloom.llm import templates
from labelloom.llm.common import read

SMALL = "/root/testdata/sf0.001"


def plain_forms(text):
    """The three token sequences as lists of (word, slot or None)."""
    tokens, opens = [], True
    for chunk in text.split():
        pieces, ends = templates._pieces(chunk)
        for value, kind, capital, unit, common in pieces:
            if kind == templates._LITERAL and unit and tokens and tokens[-1][1] == templates._NUM:
                kind = templates._UNIT
            tokens.append((value, kind, capital, common, opens))
        opens = ends
    forms = []
    for form in (0, 1):
        out, before = [], False
        for value, kind, capital, common, first in tokens:
            name = kind == templates._LITERAL and capital and not (first if form == 0 else common)
            if name and before and not first:
                out[-1] = ("name", out[-1][1] + (value,))
            elif name:
                out.append(("name", (value,)))
            else:
                out.append((value, None) if kind == templates._LITERAL else (f"slot{kind}", (value,)))
            before = name
        forms.append(out)
    words = {}
    exact = [p for chunk in text.split() for p in templates._exact_pieces(chunk, templates._WordHashes())]
    assert words == {}
    return [*forms, [(value, None) for value, _ in exact]], sum(single for _, single in exact)


def plain_windows(tokens, form, width):
    size = min(width, len(tokens))
    if size < (1 if form == 2 else 4):
        return
    for i in range(len(tokens) - size + 1):
        part = tokens[i:i + size]
        if 2 * sum(slot is None for _, slot in part) >= size:
            yield i, tuple(w for w, _ in part), [slot for _, slot in part if slot is not None]


def plain_search(docs, items):
    known, counts, runs, widths = defaultdict(list), {}, {}, defaultdict(set)
    for item, text in items:
        forms, singles = plain_forms(text)
        for form, tokens in enumerate(forms):
            cut = list(plain_windows(tokens, form, 8))
            counts[item, form] = len(cut)
            runs[item, form] = 15 * (2 if form == 2 and 2 * singles > len(tokens) else 1)
            for i, words, slots in cut:
                known[form, words].append((item, i, slots))
                widths[form].add(len(words))
    found = {}
    for doc, text in docs:
        lines = defaultdict(set)
        for form, tokens in enumerate(plain_forms(text)[0]):
            for size in widths[form]:
                for i in range(len(tokens) - size + 1):
                    if size < 4 and size != len(tokens):
                        continue
                    part = tokens[i:i + size]
                    slots = [slot for _, slot in part if slot is not None]
                    for item, at, own in known.get((form, tuple(w for w, _ in part)), ()):
                        lines[item, form, i - at].add((at, size, tuple(zip(own, slots))))
        matched, longest = defaultdict(set), defaultdict(int)
        for (item, form, _), met in lines.items():
            numbers = {}
            number = lambda slot: numbers.setdefault(slot, hash(slot))
            chosen = templates._majority([(number(a), number(b)) for _, _, pairs in met for a, b in pairs])
            kept = sorted((at, size) for at, size, pairs in met
                          if all(a == b or (number(a), number(b)) in chosen for a, b in pairs))
            covered = sorted({p for at, size in kept for p in range(at, at + size)})
            run = 0
            for n, p in enumerate(covered):
                run = run + 1 if n and covered[n - 1] == p - 1 else 1
                longest[item, form] = max(longest[item, form], run)
            matched[item, form] |= {at for at, _ in kept}
        for (item, form), places in matched.items():
            if places and (len(places) >= 0.5 * counts[item, form] or longest[item, form] >= runs[item, form]):
                share = (len(places) / counts[item, form], -form, len(places), counts[item, form])
                found[doc, item] = max(found.get((doc, item), share), share)
    return {key: best[2:] for key, best in found.items()}


def corpus(llm):
    dice = random.Random(3)
    items = [(r.item_id, r.text) for r in read(llm, SMALL, "benchmark").collect()][:40]
    items += [(9001, "too short"), (9002, "3 + 4 = 7"), (9003, "Yes"), (9004, "Anna has 12 apples and Bob has 30 km to go"),
              (9005, "天気がいいですね今日は"), (9006, "")]
    docs = [(r.doc_id, r.text) for r in read(llm, SMALL, "documents").collect() if len(r.text) < 3000][:60]
    filler = [t for _, t in docs[:20]]
    for i, (_, text) in enumerate(items * 2):
        words = text.split()
        if i % 3 == 0 and words:
            words[dice.randrange(len(words))] = dice.choice(["17", "Zoe", "else"])
        cut = words[dice.randrange(3):len(words) - dice.randrange(3)] if i % 2 else words
        docs.append((10_000 + i, f"{dice.choice(filler)[:200]} {' '.join(cut)} {dice.choice(filler)[:100]}" if i % 4 else " ".join(cut)))
    docs += [(20_000, "so too short it was"), (20_001, "Too short."), (20_002, "yes!"), (20_003, "Yes, no"), (20_004, ""),
             (20_005, "CARL has 7 apples and DORA has 9 km to go"), (20_006, "昨日の天気がいいですね今日はね")]
    return docs, items


def test_search_equals_plain_loops(llm, documents):
    docs, items = corpus(llm)
    expected = plain_search(docs, [(i, t) for i, t in items if t])
    bench = llm.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 500):
        got = {(r.doc_id, r.item_id): (r.matched, r.windows)
               for r in templates.contaminated(documents(*docs), bench, block=block).collect()}
        assert got == expected
    assert (20_001, 9001) in expected and (20_000, 9001) not in expected and (20_002, 9003) in expected
    assert (20_003, 9003) not in expected and (20_006, 9005) in expected and len(expected) > 60


def test_texts_of_a_batch_do_not_run_into_each_other(llm, documents):
    item = "one two three four five six seven eight nine ten"
    bench = llm.createDataFrame([(1, item)], "item_id long, text string")
    halves = [(i, part) for i, part in enumerate(["one two three four five", "six seven eight nine ten"] * 4)]
    assert templates.contaminated(documents(*halves).coalesce(1), bench).count() == 0
