import random

import numpy as np
import pyarrow as pa
import pytest

from lodestream.llm import mojibake

CLEAN = [
    "Für Rückfragen erreichen Sie unser Büro täglich außer sonntags, schöne Größen ab 20 € – wählen Sie.",
    "La livraison à Valby prend de 3 à 9 jours ouvrés, l’article est déjà où vous êtes, sécurité garantie.",
    "¿Alguna duda? Escríbenos, respondemos mañana mismo; el envío es gratuito también en otoño.",
    "اكتشف أغطية متينة من المنتج متوفر الآن في مقاسات",
    "Ångerrätten gäller i många år, våra cykelväskor för vår och höst.",
    "A COLEÇÃO chega a São Miguel, NÃO PERCA a PROMOÇÃO DE VERÃO.",
]
DECOYS = ["Diagonale √2 · Ø 12 mm · 20 °C ± 1", "£ 12 ¤ § ¶ © ®", "Цвет: синий, размер 42.", "Νέα συλλογή", "└── Kategorie ─ Möbel", "★★★★☆ 👍🏽", "東京の店", "ﬁne ﬂax, ½ price", "CAFÉ» «É»", "cafe\u0301"]


def sample():
    r = random.Random(1)
    return [r.choice(CLEAN) + " " + r.choice(CLEAN + DECOYS) for _ in range(600)]


def counted(texts):
    """The corpus model of distinct texts, without Spark."""
    batches = list(mojibake._count(iter([pa.record_batch([pa.array(sorted(set(texts)))], names=["text"])])))
    keys, n = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (0, 1))
    order = np.argsort(keys.astype(np.uint64))
    return keys.astype(np.uint64)[order], n[order]


BAD = {
    "utf8 as cp1252": (CLEAN[0], lambda t: t.encode().decode("cp1252")),
    "utf8 as latin-1": (CLEAN[3], lambda t: t.encode().decode("latin-1")),
    "utf8 as cp850": (CLEAN[2], lambda t: t.encode().decode("cp850")),
    "utf8 as mac": (CLEAN[1], lambda t: t.encode().decode("mac_roman")),
    "utf8 as cp1251": (CLEAN[4], lambda t: t.encode().decode("cp1251", "replace").replace(chr(0xFFFD), "")),
    "twice": (CLEAN[4], lambda t: t.encode().decode("cp1252", "ignore").encode().decode("cp1252", "ignore")),
    "cp1252 as mac": (CLEAN[0], lambda t: t.encode("cp1252").decode("mac_roman")),
}


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string")
    return {r.row_id: r.text for r in mojibake.restored(df, "i", "text").collect()}


@pytest.mark.parametrize("kind", BAD)
def test_garbled_texts_are_found_and_restored(spark, kind):
    text, spoil = BAD[kind]
    clean = sample()
    got = run(spark, [*clean, spoil(text), text[:40] + spoil(text[40:])])
    assert set(got) == {len(clean), len(clean) + 1}
    if kind != "utf8 as cp1251":
        assert got[len(clean)] == text if kind not in ("twice",) else True


def test_clean_unusual_empty_and_long_texts_are_left(spark):
    texts = [*sample(), *DECOYS, None, "", "plain", "ü" * 200_000, " ".join(CLEAN) * 200]
    assert run(spark, texts) == {}
    assert run(spark, []) == {}


def test_parts_garbled_twice_by_several_encodings_come_back_whole(spark):
    words, codecs = "Für Rückfragen erreichen Sie unser Büro täglich, schöne Größen.", ("latin-1", "cp437", "mac_roman", "cp850", "cp866")
    once = [words.encode().decode(c) for c in codecs]
    twice = [t.encode().decode(c) for t, c in zip(once, codecs, strict=True)]
    got = run(spark, [*sample(), *once, " ".join(twice)])  # a character that no other text has isn't mapped to, so those between stand alone too
    assert got[605] == " ".join([words] * len(codecs))


def test_mappings_that_undo_each_other_end(spark):
    class Circle(mojibake.Restorer):
        def from_single(self, text, *rest):
            return text.translate({ord("ä"): "ö", ord("ö"): "ü", ord("ü"): "ä"}), 1.0

        def rises(self, around):
            return [(mojibake.SINGLE[0], 99.0)]

    assert Circle(counted(["gäbe", "böte", "üben", *"gbte"])).restore("bäb") == (True, "büb")


def spoiled():
    return [x for text, spoil in BAD.values() for x in (spoil(text), text[:40] + spoil(text[40:]))]


def test_more_text_of_the_same_kind_changes_nothing():
    texts = [*sample(), *DECOYS, *spoiled()]
    keys, n = counted(texts)
    once, often = mojibake.Restorer((keys, n)), mojibake.Restorer((keys, n * 1000))
    assert [once.restore(t) for t in texts] == [often.restore(t) for t in texts]


def test_a_corpus_mostly_of_another_script_changes_nothing():
    r = random.Random(3)
    han = ["".join(chr(r.randrange(0x4E00, 0x9F00)) for _ in range(60)) for _ in range(4000)]  # ten times the rest, hardly a pair twice
    texts = [*sample(), *DECOYS, *spoiled()]
    alone, mixed = mojibake.Restorer(counted(texts)), mojibake.Restorer(counted([*texts, *han]))
    assert [alone.restore(t) for t in texts] == [mixed.restore(t) for t in texts]
    assert not any(mixed.restore(t)[0] for t in han[:200])


def test_rare_pairs_are_bounded_and_common_ones_kept(spark, monkeypatch):
    monkeypatch.setattr(mojibake, "RARE", 0.001)
    texts = [*sample(), *("x" + chr(c) for c in range(0x4E00, 0x5200))]
    keys, n = mojibake.corpus_pairs(spark.createDataFrame([(t,) for t in texts], "text string"))
    beyond = (keys & mojibake._ALONE != mojibake._ALONE) & ((keys >> np.uint64(32) > 127) | (keys & mojibake._ALONE > 127))
    assert 0 < beyond.sum() <= 1000
    whole = dict(zip(*map(list, counted(texts)), strict=True))
    assert all(whole[k] == m for k, m in zip(keys, n, strict=True))


def test_only_improbable_runs_are_mapped():
    texts = [*sample(), *spoiled()]
    r = mojibake.Restorer(counted(texts))
    tried = []
    real = r.from_utf8
    r.from_utf8 = lambda text, codec, runs: tried.extend(text[a:b] for a, b in runs) or real(text, codec, runs)
    text = CLEAN[0][:40] + CLEAN[0][40:].encode().decode("cp1252")
    assert r.restore(text) == (True, CLEAN[0])
    isolated = {CLEAN[0][a:b] for a, b in r.improbable(CLEAN[0])} | {text[a:b] for a, b in r.improbable(text)}
    assert "Ã¶" in tried and "ü" in CLEAN[0][:40] and set(tried) <= isolated | {x[0] for x in isolated}
    clean = [(a, b) for t in CLEAN for a, b in r.improbable(t)]
    assert len(clean) < sum(len(mojibake._RUN.findall(t)) for t in CLEAN)


@pytest.mark.parametrize("kind", ["utf8 as cp1252", "utf8 as cp850", "utf8 as mac"])
def test_many_copies_of_a_garbled_text_do_not_prove_it(spark, kind):
    clean = sample()
    bad = BAD[kind][1](BAD[kind][0])
    got = run(spark, [*clean, *[bad] * (len(clean) // 2)])  # a third of all rows
    assert got == {len(clean) + i: BAD[kind][0] for i in range(len(clean) // 2)}


def test_the_model_counts_distinct_texts(spark):
    df = spark.createDataFrame([(t,) for t in [*CLEAN, "Größe", *["Größe"] * 50, "plain", None, ""]], "text string")
    for a, b in zip(mojibake.corpus_pairs(df.repartition(3)), mojibake.corpus_pairs(df.distinct().coalesce(1)), strict=True):
        assert (a == b).all()


def test_pure_ascii_texts_count_in_the_model(spark):
    texts = [*CLEAN, "plain", "plain", "PLAIN 12", None, ""]
    got = mojibake.corpus_pairs(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    for a, b in zip(got, counted([t for t in texts if t]), strict=True):
        assert (a == b).all()


def test_pure_ascii_texts_show_that_letters_beside_a_garbled_run_are_common(spark):
    r = random.Random(5)
    small = [" ".join(r.choices("für schöne größen erreichen sie unser büro täglich außer sonntags".split(), k=9)) for _ in range(100)]
    plain = [" ".join(r.choices("ROUND RED DESK AND DARK DOOR FOR YOUR ROOM".split(), k=12)) + f" {i}" for i in range(500)]
    assert run(spark, [*small, *plain, "RØD", "RÃ˜D"]) == {601: "RØD"}


def test_lost_bytes_are_found(spark):
    text = "Gr" + chr(0xFFFD) + "ße"
    assert run(spark, [*sample(), text, text]) == {600: text, 601: text}


def test_segments_are_the_maximal_ones():
    assert mojibake.segments([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5]) == [(0, 1, 4), (2, 3, 3), (4, 11, 7)]
    assert mojibake.segments([]) == [] and mojibake.segments([-1.0]) == []
