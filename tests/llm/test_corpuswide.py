"""Operators over a whole corpus against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from placewise.llm import queries
from placewise.llm.components import connected_components
from placewise.llm.decontamination import ItemIndex, drop_leaking, find_leaks
from placewise.llm import components, minhash
from placewise.llm.minhash import keep_one_of_each, near_duplicates
from placewise.llm.ngram_lm import is_held_out, score_documents, train_bigrams
from placewise.llm.quality import judge_quality
from placewise.llm.secrets import find_spans, redact
from placewise.llm.substring_dedup import best_passages, chosen_places, chosen_tokens, dense_regions, near_duplicate_passages
from tests.conftest import SMALL

MIDDLE = SMALL.replace("0.001", "0.01")
WORDS = re.compile("[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(folder):
    return [(d["doc_id"], d["text"] or "") for d in pq.read_table(f"{folder}/documents.parquet").to_pylist()]


def shingle_set(text, k):
    words = WORDS.findall(lower(text))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def brute_groups(texts, k, percent):
    sets = {key: shingle_set(text, k) for key, text in texts}
    by = defaultdict(set)
    for key, own in sets.items():
        for s in own:
            by[s].add(key)
    parent = {key: key for key in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, own in sets.items():
        shared = Counter(b for s in own for b in by[s] if b > a)
        for b, n in shared.items():
            if 100 * n >= percent * (len(own) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {key: (len(sets[key]), root(key)) for key in sets}


# --- near-duplicates ----------------------------------------------------------------------------------------
def test_near_duplicates_query(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op7_near_duplicates"](spark, MIDDLE).collect()}
    assert got == brute_groups(documents(MIDDLE), 3, 85)


def chained(n=60, words=120):
    """Texts that each change a few words of the one before: links form a chain, far ones are not similar; and a large group of near copies."""
    base, out = [f"w{i}" for i in range(words)], []
    for i in range(n):
        base = base.copy()
        base[(i * 17) % words] = f"c{i}"
        out.append((1000 - i, " ".join(base)))
    hot = [f"h{i}" for i in range(200)]
    for i in range(150):
        own = hot.copy()
        own[i] = f"x{i}"
        out.append((5000 + i, " ".join(own)))
    return out + [(9000 + i, "same text here today") for i in range(30)] + [(9100 + i, "a b") for i in range(3)] + [(9200, ""), (9201, "")]


def test_chains_and_hot_groups(spark):
    rows = chained()
    for k, percent in ((3, 85), (5, 80)):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = near_duplicates(docs, k=k, percent=percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, k, percent)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = keep_one_of_each(docs).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in brute_groups(rows, 5, 80).values()})


def test_pairs_in_a_family(spark):
    """Texts of one template are all somewhat alike, too little for a link; each has one partner. Large buckets, many groups."""
    rows, same = [], [f"t{i}" for i in range(360)]
    for i in range(400):
        pair = [f"p{i}x{j}" for j in range(17)]
        rows += [(2 * i + side, " ".join(same + pair + [f"u{i}x{side}x{j}" for j in range(25)])) for side in (0, 1)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=1, percent=85).collect()
    assert {r.doc_id: r.component_id for r in got} == {key: key // 2 * 2 for key, _ in rows}


def test_rows_go_by_their_own_text(spark):
    """A key with a copied and a clean text, a key repeated as it is, two near texts under one key, empty texts under one key."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in "abc")
    rows = [(1, a), (5, a + " more"), (5, b), (7, c), (7, c), (8, "quite another text of ten words that nobody has but this"), (8, "quite another text of ten words that nobody has but this"), (None, a), (None, a), (9, ""), (9, None), (6, b)]
    docs = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "doc_id long, TEXT string, component_id int")
    got = keep_one_of_each(docs, text="TEXT")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.TEXT) for r in got.collect()), key=repr) == sorted([(1, a), (5, b), (7, c), rows[5], (None, a), (None, a), (9, ""), (9, None)], key=repr)


def test_no_growing_side_is_broadcast(spark, monkeypatch):
    """However high the planner's limit is, only the table of bits with its fixed size is broadcast."""
    plans, write = [], minhash.materialize

    def noted(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return write(df)

    for module in (minhash, components):
        monkeypatch.setattr(module, "materialize", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        words = [" ".join(f"w{i % 7}{j}" for j in range(40)) for i in range(20)]
        rows = [(i if i else None, w + " end" * (i % 3), i % 2 == 0) for i, w in enumerate(words * 2)]
        docs = spark.createDataFrame([*rows, (5, "other words altogether " * 9, True)], "doc_id long, text string, even boolean")
        kept = keep_one_of_each(docs)
        plans.append(kept._jdf.queryExecution().sparkPlan().toString())
        assert len(kept.collect()) == 7 + 2  # the row without a key and the other text of key 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    broadcast = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line]
    assert len(broadcast) >= 2 and all("_pw_spots_row" in line for line in broadcast)


def test_keys_in_a_table_of_bits(spark):
    rows = spark.range(-300, 2000).select(F.when(F.col("id") != 7, F.col("id")).alias("k"), F.lit("x").alias("t"))
    found = minhash._maybe_among(rows, "k", rows.where("k % 3 = 0").select(F.col("k").alias("key")))
    assert found.columns == ["k", "t", "_pw_maybe"] and found.count() == 2300
    counts = {(r.third, r._pw_maybe): r["count"] for r in found.groupBy((F.coalesce(F.pmod("k", F.lit(3)), F.lit(1)) == 0).alias("third"), "_pw_maybe").count().collect()}
    assert (True, False) not in counts and counts[True, True] == 766 + 1 and counts.get((False, True), 0) < 5


def test_near_duplicates_odd_rows(spark, odd):
    got = near_duplicates(odd, k=3, percent=85).collect()
    assert len(got) == odd.count() and sum(r.doc_id is None for r in got) == 1
    groups = {r.doc_id: r.component_id for r in got}
    assert groups[8] == groups[9] == 8 and groups[0] == 0 and groups[1] == 1
    assert near_duplicates(odd.limit(0)).count() == 0
    assert keep_one_of_each(odd).columns == odd.columns


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i != 20] + [(50, 60), (60, 50), (7, 7)], "a long, b long")
    ids = spark.createDataFrame([(i,) for i in [*range(41), 50, 60, 70]], "id long")
    got = {r.id: r.component for r in connected_components(links, ids).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 21 for i in range(21, 41)}, 50: 50, 60: 50, 70: 70}


# --- benchmark leaks ----------------------------------------------------------------------------------------
def letters(text):
    return re.findall(r"[^\W_]+|[^\x00-\x7f]+", text.lower())


def brute_leaks(docs, items, least=0.8):
    found = set()
    for item, text in items:
        own = WORDS.findall(re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", text.lower()))
        k = min(5, len(own))
        weights = {tuple(own[i : i + k]): sum(len(w.encode()) for w in own[i : i + k]) for i in range(len(own) - k + 1)} if own else {}
        for key, body in docs:
            words = WORDS.findall(re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", body.lower()))
            at = [i for i in range(len(words) - k + 1) if tuple(words[i : i + k]) in weights] if k else []
            for i in at:
                near = {tuple(words[j : j + k]) for j in at if i <= j <= i + len(own) - k}
                if sum(weights[s] for s in near) >= least * sum(weights.values()):
                    found.add((key, item))
                    break
    return found


def test_leaks_query(spark):
    got = queries.QUERIES["op3_decontaminate"](spark, MIDDLE).collect()
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{MIDDLE}/benchmark.parquet").to_pylist()]
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(documents(MIDDLE), items)
    assert got and all(0.8 <= r.similarity <= 1 for r in got)


def test_leaks_odd_rows(spark, odd):
    item = "The quick brown fox jumps over the lazy dog while seven wizards quietly brew potions under the old stone bridge at night"
    edited = item.replace("night", "dusk")
    docs = spark.createDataFrame([(1, "intro words here. " * 50 + item.upper() + "!!! tail"), (2, f"({edited}) and more"), (3, item[:60]), (None, item), (5, None), (6, "short item"), (6, "short item")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item, 1), (8, None, 1), (9, "", 1), (None, "short item", 1), (11, "!!!", 1), (12, "one", 1)], "item_id long, text string, doc_id int")
    got = sorted(((r.doc_id, r.item_id) for r in find_leaks(docs, items, block=2).collect()), key=repr)
    assert got == sorted([(1, 7), (2, 7), (None, 7), (6, None), (6, None)], key=repr)
    assert [r.doc_id for r in drop_leaking(docs, items).orderBy("doc_id").collect()] == [3, 5]
    assert find_leaks(odd, items).where("item_id = 12").count() == 1
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0


def test_edited_leaks_of_all_lengths():
    import random

    import pyarrow as pa

    rng = random.Random(3)
    vocab = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(1, 10))) for _ in range(20_000)]
    items, docs, want = [], [], set()
    for n in [*range(6, 101), *[20, 21, 29, 30, 42] * 60]:
        for edits in (1, 1, 2, 3) if n > 50 else (1, 1):
            own = rng.choices(vocab, k=n)
            edited = own.copy()
            for _ in range(edits):
                at = rng.randrange(len(edited))
                edited[at : at + rng.randrange(2)] = rng.choices(vocab, k=rng.randrange(2))
            items.append((len(items), " ".join(own)))
            docs.append((len(docs), " ".join(rng.choices(vocab, k=rng.randrange(5, 40)) + edited + rng.choices(vocab, k=rng.randrange(5, 40)))))
            want |= brute_leaks(docs[-1:], items[-1:])
    index = ItemIndex(*zip(*items))
    got = {f[:2] for f in index.leaks(pa.array([d for _, d in docs]), 0.8)}
    assert len(want) > 300 and not want - got


# --- passages -----------------------------------------------------------------------------------------------
def test_passages(spark):
    import random

    rng = random.Random(5)
    filler = lambda n: [f"{rng.choice('abcdefgh')}{rng.randrange(5000)}" for _ in range(n)]
    exact, nearly, short = filler(60), filler(80), filler(45)
    changed = nearly.copy()
    changed[40] = "changed"
    inserted = nearly[:40] + ["inserted"] + nearly[40:]
    plant = {1: exact, 2: exact, 3: nearly, 4: changed, 5: short, 6: short, 7: inserted, **{i: exact for i in range(100, 140)}}
    rows = [(i, " ".join(filler(rng.randrange(200)) + plant.get(i, []) + filler(rng.randrange(200)))) for i in range(160)]
    rows += [(500, None), (501, ""), (None, " ".join(exact)), (1, "another row with this key")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicate_passages(docs).collect()
    assert sorted(got) == sorted(near_duplicate_passages(docs, hot_key=5).collect())
    named = {d for r in got for d in (r.doc_id, r.other_doc_id)}
    assert named == {1, 2, 3, 4, 7, *range(100, 140)}
    for r in got:
        if r.doc_id in (2, *range(100, 140)) and r.other_doc_id == 1:
            words = dict(rows[:160])[r.doc_id].split()
            assert words[r.first_word : r.first_word + r.n_words] == exact
    assert len(got) < 200


def test_edited_passages_at_every_place():
    fresh = iter(range(1, 10_000_000))

    def shingled(words):
        return [tuple(words[i : i + 5]) for i in range(len(words) - 4)]

    def numbers(*lists):
        names = {}
        return [np.array([names.setdefault(s, len(names)) for s in x], np.int32) for x in lists]

    around = lambda: [next(fresh) for _ in range(80)]
    for n in range(50, 71):
        for place in range(n):
            passage = [next(fresh) for _ in range(n)]
            edited = [*passage[:place], next(fresh), *passage[place + 1 :]]
            a, b = set(shingled(passage)), set(shingled(edited))
            if n == 50 and place in (4, 45):  # to shingles the same as a repeat of 45 words, which is none
                continue
            own, other = numbers(shingled(around() + passage + around()), shingled(around() + edited + around()))
            found = best_passages(own, other, 46, 0.8)
            assert bool(found) == (len(a & b) / len(a | b) >= 0.8), (n, place)
            for first, last, o_first, o_last, alike in found:
                x, y = set(own[first : last + 1].tolist()), set(other[o_first : o_last + 1].tolist())
                assert min(last - first, o_last - o_first) >= 45 and alike == len(x & y) / len(x | y) >= 0.8
    short = [next(fresh) for _ in range(45)]
    assert not best_passages(*numbers(shingled(around() + short + around()), shingled(around() + short + around())), 46, 0.8)


def test_passages_query(spark):
    """Recall of documents against a comparison of all pairs that share a shingle; exact repeats of more than 50 words all count."""
    got = queries.QUERIES["op4_repeated_passages"](spark, MIDDLE).collect()
    texts = dict(documents(MIDDLE))
    words = {key: WORDS.findall(lower(text)) for key, text in texts.items()}
    holders, names, by = defaultdict(set), {}, defaultdict(set)
    for key, own in words.items():
        for i in range(len(own) - 50):
            holders[tuple(own[i : i + 51])].add(key)
        for i in range(len(own) - 4):
            by[names.setdefault(tuple(own[i : i + 5]), len(names))].add(key)
    exact = {key for keys in holders.values() if len(keys) > 1 for key in keys}
    numbers = {key: np.array([names[tuple(own[i : i + 5])] for i in range(len(own) - 4)], np.int32) for key, own in words.items()}
    shared = Counter((a, b) for keys in by.values() if len(keys) > 1 for a in keys for b in keys if a < b)
    # Of 46 shingles or more on either side at least 41 are shared.
    near = {pair for pair, n in shared.items() if n >= 41 and best_passages(numbers[pair[1]], numbers[pair[0]], 46, 0.8)}
    want = exact | {key for pair in near for key in pair}
    named = {d for r in got for d in (r.doc_id, r.other_doc_id)}
    assert exact <= named
    assert named <= want and len(named) >= 0.99 * len(want)  # 228 of 228 when written
    for r in got:
        a, b = (words[d][f : f + n] for d, f, n in ((r.doc_id, r.first_word, r.n_words), (r.other_doc_id, r.other_first_word, r.other_n_words)))
        a, b = shingle_set(" ".join(a), 5), shingle_set(" ".join(b), 5)
        assert len(a & b) / len(a | b) >= 0.8 - 1e-9 and abs(r.similarity - len(a & b) / len(a | b)) < 1e-9


def test_passages_lose_no_link(spark):
    """Pairs just similar enough, and a pair whose every shingle the smallest and the largest document hold in other text."""
    import random

    rng = random.Random(8)
    fresh = iter(range(10_000_000))
    filler = lambda n: [f"w{next(fresh)}" for _ in range(n)]
    rows, pairs = [], []
    for i in range(200):
        passage = filler(50)
        edited = passage.copy()
        edited[rng.randrange(5, 45)] = filler(1)[0]
        pairs.append((1000 + i, 3000 + i))
        rows += [(d, " ".join(filler(rng.randrange(9)) + p + filler(rng.randrange(9)))) for d, p in zip(pairs[-1], (passage, edited))]
    whole = filler(60)
    pieces = lambda: [w for j in range(0, 60, 8) for w in whole[j : j + 12] + filler(30)]
    rows += [(1, " ".join(pieces())), (9999, " ".join(pieces()))]
    rows += [(d, " ".join(filler(20) + whole + filler(20))) for d in (5000, 5001)]
    got = near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {tuple(sorted((r.doc_id, r.other_doc_id))) for r in got} == {*pairs, (5000, 5001)}
    assert all(r.class_id == min(r.doc_id, r.other_doc_id) for r in got)


def test_chosen_places_and_regions():
    """Whatever a passage's disagreeing places are, a chosen one agrees; regions cover every stretch that is dense enough."""
    rng = np.random.default_rng(4)
    for least, share in ((46, 0.8), (10, 0.7), (20, 0.9)):
        for _ in range(20):
            size = int(rng.integers(least, 5 * least))
            chosen, sure = chosen_places(rng.integers(1, 9, size), least, share)
            assert sure >= 1
            lone = (rng.random(size) < 1.3 * (1 - share)).astype(float)
            covered = np.zeros(size, bool)
            for first, end in dense_regions(lone, least, share):
                covered[first:end] = True
            sums, picks = np.append(0, np.cumsum(lone)), np.append(0, np.cumsum(chosen))
            for a in range(size):
                for b in range(a + least, size + 1):
                    if sums[b] - sums[a] <= (1 - share) * (b - a):
                        assert covered[a:b].all()
                    # The piece with the fewest disagreeing places has no more than its share of them.
                    if b - a < 2 * least:
                        assert picks[b] - picks[a] >= int((1 - share) * (b - a) + 1e-6) + sure
            keys = rng.integers(0, size, size).astype(np.uint64)
            tokens, held = np.unique(keys), rng.integers(2, 9, len(np.unique(keys)))
            chosen, sure, _ = chosen_tokens(keys, tokens, held, least, share)
            for a in range(size - least + 1):
                own = np.unique(keys[a : a + least])
                unlike = int((1 - share) * len(own) + 1e-6)
                assert np.isin(own, tokens[chosen]).sum() - unlike >= 0 and len(own) - unlike - (~chosen).sum() >= sure >= 1


def test_passages_odd_rows(spark, odd):
    assert near_duplicate_passages(odd).count() == 0
    assert near_duplicate_passages(odd.limit(0)).count() == 0


# --- language model -----------------------------------------------------------------------------------------
class PlainModel:
    def __init__(self, texts):
        self.one, self.two = Counter(), Counter()
        for text in texts:
            words = [*WORDS.findall(lower(text)), None]
            self.one.update(words)
            self.two.update(zip(["<s>", *words], words))
        self.before = Counter(v for _, v in self.two)
        self.context, self.after = Counter(), defaultdict(Counter)
        for (u, _), n in self.two.items():
            self.context[u] += n
            self.after[u][min(n, 3)] += 1
        self.d2, self.d1 = self.discounts(self.two), self.discounts(self.before)

    @staticmethod
    def discounts(counts):
        n = [0, *(sum(1 for c in counts.values() if c == k) for k in (1, 2, 3, 4))]
        if min(n[1:]) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3))]

    def score(self, text):
        words = [*WORDS.findall(lower(text)), None]
        total, base, all_one = 0.0, 0.0, sum(self.one.values())
        pairs = max(sum(self.before.values()), 1)
        kinds = Counter(min(n, 3) for n in self.before.values())
        rest = sum(self.d1[k] * kinds[k] for k in (1, 2, 3)) / pairs if self.before else 1.0
        for u, v in zip(["<s>", *words], words):
            low = max(self.before[v] - self.d1[min(self.before[v], 3)], 0) / pairs + rest / (len(self.one) + 1)
            c, n = self.two[u, v], self.context[u]
            p = max(c - self.d2[min(c, 3)], 0) / n + sum(self.d2[k] * self.after[u][k] for k in (1, 2, 3)) / n * low if n else low
            total += math.log10(p)
            base += math.log10((self.one[v] + 0.1) / (all_one + 0.1 * (len(self.one) + 1)))
        return len(words), sum(self.one[w] > 0 for w in words), base, total


def same(got, want):
    assert (got.n_tokens, got.n_known) == want[:2]
    assert math.isclose(got.base_score, want[2], rel_tol=1e-9) and math.isclose(got.score, want[3], rel_tol=1e-9)


def test_language_model_query(spark):
    docs = documents(SMALL)
    held = {key: zlib.crc32(str(key).encode()) % 10 == 0 for key, _ in docs}
    model = PlainModel(text for key, text in docs if not held[key])
    got = {r.doc_id: r for r in queries.QUERIES["op10_language_model"](spark, SMALL).collect()}
    for key, text in docs:
        same(got[key], model.score(text))
        assert got[key].held_out == held[key] and got[key].train_tokens == sum(model.one.values())
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # the model is better than word counts on unseen texts


def test_language_model_odd_rows(spark, odd):
    texts = [r.text for r in odd.collect()]
    model, plain = train_bigrams(odd), PlainModel(texts)
    for r in score_documents(odd, model).collect():
        same(r, plain.score(r.text))
    nothing = train_bigrams(odd.limit(0))
    for r in score_documents(odd, nothing).collect():
        same(r, PlainModel([]).score(r.text))
    assert odd.where(is_held_out("doc_id")).count() == sum(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in odd.collect() if r.doc_id is not None)


# --- pipeline -----------------------------------------------------------------------------------------------
def test_pipeline(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    kept = {r.doc_id: r.text for r in judge_quality(docs, spark.read.parquet(f"{MIDDLE}/labels.parquet")).where("kept").collect()}
    groups = brute_groups(kept.items(), 5, 80)
    kept = {key: text for key, text in kept.items() if groups[key][1] == key}
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{MIDDLE}/benchmark.parquet").to_pylist()]
    leaking = {key for key, _ in brute_leaks(kept.items(), items)}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want = {}
    for key, text in kept.items():
        if key not in leaking:
            clean = redact(text, find_spans(text))
            want[key] = (clean, len(clean), library.encode(clean, add_special_tokens=False).ids)
    got = corpus_pipeline.run(spark, MIDDLE).collect()
    assert {r.doc_id: (r.text, r.n_chars, list(r.ids)) for r in got} == want and len(got) == len(want)
    assert leaking and any("[secret]" in t for t, _, _ in want.values())


def test_stages_keep_columns_and_odd_rows(spark, odd):
    docs = odd.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("kept", F.lit("mine")).withColumn("body", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        if name != "encode":
            assert out.columns == docs.columns, name
        if name == "hide_secrets":
            assert out.count() == docs.count()
