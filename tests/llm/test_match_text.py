import random
from collections import Counter

import numpy as np
import pytest

from crysmill.llm import entity_match as em
from crysmill.llm import mixing, packing, spam
from crysmill.llm.tokens import counted, default_vocabulary, encode, encoding

MAT = "record_no bigint, material_id string, formula string, structure struct<lattice: array<array<double>>, species: array<string>, coords: array<array<double>>>, properties array<struct<name: string, value: double, value_text: string, unit: string>>, jid string, ref string"
JAR = "jid string, formula string, atoms struct<lattice_mat: array<array<double>>, elements: array<string>, coords: array<array<double>>>, density double, bulk_modulus_kv string, shear_modulus_gv string, legacy_ref string, mid string"


def cell(a, species):
    return ([[a, 0.0, 0.0], [0.0, a, 0.0], [0.0, 0.0, a]], species, [[0.0, 0.0, 0.0]] * len(species))


def mat(no, mid, formula, a=None, rho=None, k=None):
    props = [("density", rho, None, "g/cm^3")] * (rho is not None) + [("K_VRH", k, None, "GPa")] * (k is not None)
    return (no, mid, formula, None if a is None else cell(a, ["Ti", "N"]), props or None, "clash", None)


def jar(jid, formula, a=None, rho=None, k="na", g="na", ref=None):
    return (jid, formula, None if a is None else cell(a, ["N", "Ti"]), rho, k, g, ref, None)


def matched(spark, mats, jars):
    out = em.match(em.left_side(spark.createDataFrame(mats, MAT)), em.right_side(spark.createDataFrame(jars, JAR))).collect()
    assert all(0 < r["confidence"] < 1 for r in out)
    return {r["jid"]: (r["mid"], r["rule"]) for r in out}


def test_cascade(spark):
    mats = [mat(1, "demo-nti-cf-00000001", "TiN", 4.0), mat(2, "demo-nti-cf-00000001", "TiN", 4.0), mat(3, "demo-nti-hp-00000002", "TiN", 4.4), mat(4, "demo-nti-op-00000003", "TiN", None, 9.0), mat(5, "demo-nti-mc-00000004", "Ti2N", 4.0), mat(6, None, "TiN", 4.0), mat(7, "demo-x-00000005", "TiN", None, None, 123.0)]
    jars = [
        jar("by_cell", "N2Ti2", 4.02), jar("other_phase", "TiN", 4.8), jar("by_density", "TiN", None, 9.1), jar("by_trace", "TiN", 4.41, ref="prev. DEMO_NTI_HP_00000002"), jar("bad_trace", "Ti2N", None, 5.0, ref="demo-nti-cf-00000001"),
        jar("contradicted", "TiN", 4.8, ref="demo-nti-cf-00000001"), jar("by_moduli", "TiN", None, None, "124.0"), jar("nothing", None, None, None), jar("atoms_only", None, 3.99), jar("nan", "TiN", None, float("nan")), jar(None, "TiN", 4.0), jar("by_cell", "N2Ti2", 4.02),
    ]
    got = matched(spark, mats, jars)
    assert got == {"by_cell": ("demo-nti-cf-00000001", "cell_volume"), "by_density": ("demo-nti-op-00000003", "density"), "by_trace": ("demo-nti-hp-00000002", "trace"), "by_moduli": ("demo-x-00000005", "bulk_modulus"), "atoms_only": ("demo-nti-cf-00000001", "cell_volume")}


def test_confidence_is_precision_on_what_is_left(spark):
    mats = [mat(i, f"demo-tin-cf-{i:08d}", "TiN", 4.0 * 1.05**i if i < 4 else None, None if i < 4 else 5.0 * 1.1**i) for i in range(8)]
    ref = lambda i: f"demo-tin-cf-{i:08d}"
    jars = [jar(f"a{i}", "TiN", 4.0 * 1.05**i, ref=ref(i)) for i in range(4)]
    # labelled, without a cell: left when the density's turn comes; nothing measured contradicts the wrong trace of w
    jars += [jar(f"b{i}", "TiN", None, 5.0 * 1.1**i, ref=ref(i)) for i in (4, 5)] + [jar("w", "TiN", None, None, ref=ref(3)), jar("open", "TiN", None, 5.01 * 1.1**6)]
    out = {r["jid"]: r for r in em.match(em.left_side(spark.createDataFrame(mats, MAT)), em.right_side(spark.createDataFrame(jars, JAR))).collect()}
    assert len(out) == 8 and {r["rule"] for j, r in out.items() if j != "open"} == {"trace"}
    assert out["a0"]["confidence"] == pytest.approx(8 / 9) and (out["open"]["mid"], out["open"]["rule"]) == (ref(6), "density") and out["open"]["confidence"] == pytest.approx(3 / 4)


def test_copies_are_matched_as_one(spark):
    mats = [mat(i, f"m-{i:03d}", "TiN", 4.0) for i in range(60)]
    got = matched(spark, mats, [jar(f"j{i}", "TiN", 4.01) for i in range(60)])
    assert len(got) == 60 and set(got.values()) == {("m-000", "cell_volume")}


def test_cascade_empty(spark):
    assert matched(spark, [], []) == {} and matched(spark, [mat(1, "a", "TiN", 4.0)], []) == {}


PROSE = "The density of TiN stayed near 5.4 g/cm^3 after the second pass, and we do not know why the first attempt failed. "
SPAM_TAIL = "zinc selenide wafer cheap zinc selenide wafer deal zinc selenide wafer. " * 8
SPAM = ["Keywords: foil, rod, foil, rod, foil, oxide foil, rod, foil, oxide foil, rod, foil, rod", "Gallium oxide boat powder gallium oxide boat! Gallium oxide boat order now gallium oxide boat price? " * 4, "rod\ndiscount\nboron carbide\nrod\nrod\ndiscount\nboron carbide\nrod\ndiscount", "Tags: #oxide #foil #oxide #foil #powder #target #oxide", "Home > Shop > Hafnium Carbide > Rod > Page 4\nHome / All items / Cerium Oxide / Foil\n" * 3, "https://a-shop.example/foil1 https://b-shop.test/rod2\nhttps://c.example/item?id=3", "SKU 3708; ZrB2 rod; 3 in; 799.00; in stock\nSKU 57180; CeO2 disc; 2 in; 727.00; sale\n" * 2, '<a href="https://x.test/a">tin foil</a> | <a href="https://x.test/b">tin rod</a>', "supplier; powder; powder; in stock; supplier; powder; boron carbide; supplier; boron carbide", PROSE + SPAM_TAIL]
FINE = [PROSE, "", "   ", "ok", "12 34 56", "B4C data card\nPoisson ratio: 11 % (measured)\ncell volume: 6.16 Å^3 (estimated)\ndensity: 3 g/cm^3 (computed)", "[000] Ga2O3 relax energy=-2.21853 force=0.2030\nstep    1  E = -2.226009 eV  fmax = 0.10521", "material | density | bulk\nSiC | 3.2 | 220\nTiN | 5.4 | 290\nAlN | 3.2 | 200", "* Fixed the relaxation option that ignored the cell volume.\n- Removed the import option that dropped the band gap.", "```\nframe = frame.where('density < 65')\nframe = frame.where('x < 5')\n```", PROSE + "\n\nReferences\n[1] https://a.example/x\n[2] https://b.test/y", "Die Dichte von X blieb bei der 2. Messung nahezu unverändert.\n\nKeywords: residual force, density, shear modulus, energy above the hull, bulk modulus", "Nach 84 Minuten wurde der Lauf abgebrochen, weil der Druck schwankte.", "Il faudra vérifier l'unité avant de comparer ces valeurs.", PROSE * 3 + "foil foil foil foil foil foil foil foil foil foil"]


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    assert spam.judge(text).spam


@pytest.mark.parametrize("text", FINE)
def test_fine(text):
    assert not spam.judge(text).spam


MATERIALS = ("titanium nitride", "gallium oxide", "boron carbide", "scandium aluminium nitride", "tin oxide")
PHRASES = ["buy titanium nitride powder near me\n" * 50, "Buy titanium nitride powder near me! " * 20, "buy titanium nitride powder near me " * 30, "\n".join(f"buy {m} {f} near me" for m in MATERIALS for f in ("powder", "foil", "rod", "wafer", "target", "disc")), "where to buy titanium nitride powder for the best price near me\n" * 30, "Buy cheap titanium nitride sputter target powder from top factory supplier in harbor city near me. " * 20]


@pytest.mark.parametrize("text", PHRASES)
def test_stuffed_phrases_with_function_words(text):
    assert spam.judge(text, {w: True for w in ("from", "in", "near", "me", "the", "for", "my", "of", "and")}).spam


def test_told_again_is_no_stuffing():
    assert not spam.judge("Conviene revisar la unidad antes de comparar los valores. " * 5).spam
    assert not spam.judge("We do not know why the first attempt failed. " * 6).spam


def test_nouns_count_only_in_a_row():
    # enough terms, but no 12 different ones in a row and none that comes back
    assert not spam.judge("foil, rod, disc, or oxide, boat, wafer, target or bulk, deal, price, cheap, coast, north", {"or": True}).spam
    assert spam.judge("foil, rod, disc, oxide, boat, wafer, target, bulk, deal, price, cheap, coast, north").spam


def test_recurrence_of_regular_and_random_terms():
    back, even, peak = spam.recurrence(["a", "b", "c"] * 20)
    assert back > 0.9 and even == 1.0 and peak == pytest.approx(1.0)
    rnd = random.Random(0)
    back, _, peak = spam.recurrence([str(rnd.random()) for _ in range(60)])
    assert back == 0.0 and peak == 0.0 and spam.recurrence([]) == (0.0, 0.0, 0.0)


# prose of languages that no corpus here knows
FOREIGN = (
    "De onderzoekers hebben vorig jaar een nieuwe methode ontwikkeld om de sterkte van het materiaal te meten. Daarna is het monster opnieuw verwarmd en langzaam afgekoeld.",
    "Badacze opracowali w zeszłym roku nową metodę pomiaru wytrzymałości materiału. Następnie próbka została ponownie podgrzana i powoli schłodzona.",
    "Исследователи в прошлом году разработали новый метод измерения прочности материала. Затем образец был снова нагрет и медленно охлаждён.",
    "Forskarna utvecklade förra året en ny metod för att mäta materialets styrka. Sedan värmdes provet igen och kyldes långsamt.",
    "Araştırmacılar geçen yıl malzemenin dayanıklılığını ölçmek için yeni bir yöntem geliştirdi. Ardından numune tekrar ısıtıldı ve yavaşça soğutuldu.",
    "I ricercatori hanno sviluppato l'anno scorso un nuovo metodo per misurare la resistenza del materiale. Poi il campione è stato riscaldato di nuovo.",
    "Tutkijat kehittivät viime vuonna uuden menetelmän materiaalin lujuuden mittaamiseen. Sen jälkeen näyte kuumennettiin uudelleen ja jäähdytettiin hitaasti.",
    "研究人员去年开发了一种测量材料强度的新方法。随后样品再次加热并缓慢冷却。结果比预期好，但并非在所有情况下都如此。",
    "Os pesquisadores desenvolveram no ano passado um novo método para medir a resistência do material. Depois a amostra foi aquecida de novo.",
    "Vědci loni vyvinuli novou metodu měření pevnosti materiálu. Poté byl vzorek znovu zahřát a pomalu ochlazen.",
)


@pytest.mark.parametrize("text", FOREIGN)
def test_prose_of_unknown_languages_stays(text):
    for words in ({}, {"the": True, "of": True, "and": True, "de": True, "oxide": False}):
        assert not spam.judge(text, words).spam


def test_stuffing_of_unknown_languages_is_found():
    assert spam.judge("goedkope schoenen kopen goedkope schoenen online goedkope schoenen winkel goedkope schoenen korting").spam


def test_recurrence_decides(monkeypatch):
    stuffed = "silicon carbide powder cheap silicon carbide powder best silicon carbide powder online silicon carbide cheap"
    links = "\n".join(f'<a href="x{i}">{"word " * 150}{i}</a>' for i in range(9))
    assert spam.judge(stuffed).spam and spam.judge(links).spam and spam.judge(links).kind == "links"
    monkeypatch.setattr(spam, "recurrence", lambda *a: (0.0, 0.0, 0.0))
    assert not spam.judge(stuffed).spam and not spam.judge(links).spam


def test_plain_words_are_learned(spark):
    rows = [(i, f"the band of item {i % 7} was wide, so it went to the shelf and a note was kept", "en") for i in range(400)]
    rows += [(1000 + i, "zinc rod zinc rod cheap zinc rod zinc rod", "en") for i in range(20)] + [(2000, None, "en"), (2001, "", "xx")]
    words = spam.plain_words(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert words["was"] and words["shelf"] and not words["zinc"] and not words["rod"] and "cheap" in words
    assert spam.plain_words(spark.createDataFrame([], "text string")) == {}


def test_spam_operator(spark):
    rows = [(1, None), (2, ""), (3, SPAM[0]), (4, SPAM[0]), (5, PROSE * 20_000), (6, SPAM[1] * 20_000)]
    df = spark.createDataFrame([(*r, "clash", True) for r in rows], "doc_id bigint, text string, id string, is_spam boolean")
    assert {r["doc_id"] for r in spam.judged(df).where("is_spam").collect()} == {3, 4, 6}
    assert spam.judged(df.limit(0)).count() == 0


DOCS = "doc_id bigint, text string, lang string, source string, n int, before string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "clash") for i, t, lang, s in rows], DOCS)


def test_packing_is_exact(spark):
    rnd = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))), rnd.choice(["en", None]), rnd.choice(["a", "a", "b", None])) for i in range(400)]
    rows += [(900, " ".join(rnd.choice(words) for _ in range(3000)), "en", "a"), (901, None, "en", "a"), (902, "", "en", "a"), (903, rows[0][1], "en", "a"), (903, rows[0][1], "en", "a"), (None, "one", None, None)]
    sizes = spark.createDataFrame([("small", 128), ("large", 1000), (None, 5), ("none", None), ("zero", 0)], "container_kind string, capacity_tokens int")
    out = packing.pack(docs(spark, rows), sizes, default_vocabulary(), shard_tokens=8000).toPandas()
    enc = encoding(default_vocabulary())
    want = Counter()
    for i, t, *_ in rows:
        if t:
            want[-1 if i is None else i] += len(encode(t, enc))
    for kind, cap in (("small", 128), ("large", 1000)):
        k = out[out.container_kind == kind]
        assert k.groupby("container_id").n_tokens.sum().max() <= cap
        assert k.fillna({"doc_id": -1}).groupby("doc_id").n_tokens.sum().to_dict() == dict(want)
        whole = [i for i, t, *_ in rows if t and i not in (None, 903) and len(encode(t, enc)) <= cap]
        assert (k[k.doc_id.isin(whole)].groupby("doc_id").size() == 1).all()
        assert k.n_tokens.sum() / (k.container_id.nunique() * cap) > 0.9
    assert set(out.container_kind) == {"small", "large"}
    assert packing.pack(docs(spark, []), sizes, default_vocabulary()).count() == 0


def test_index_ranks_like_brute_force():
    rnd = np.random.default_rng(1)
    items = [rnd.integers(0, 50, rnd.integers(5, 40)).astype(np.uint16) for _ in range(60)]
    df = np.zeros(packing.VOCABULARY, np.int64)
    for x in items:
        df[np.unique(x)] += 1
    mean = float(np.mean([len(x) for x in items]))
    got = packing.Index(items, df, 60, mean).scores(items[7])
    for i, x in enumerate(items):
        want = sum(np.log1p((60 - df[t] + 0.5) / (df[t] + 0.5)) * (x == t).sum() * 2.2 / ((x == t).sum() + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in np.unique(items[7]) if (x == t).any())
        assert got[i] == pytest.approx(want)


@pytest.mark.parametrize("weights,seats", [({"a": 0.5, "b": 0.3, "c": 0.2}, 10), ({"a": 1.0}, 7), ({"a": 0.34, "b": 0.33, "c": 0.33}, 100), ({"a": 0.9, "b": 0.0}, 5), ({}, 3), ({"x": 0.001, "y": 0.999}, 1000), ({"a": 1.0, "b": 1.0}, 0)])
def test_sainte_lague_against_plain(weights, seats):
    want = dict.fromkeys(weights, 0)
    if any(w > 0 for w in weights.values()):
        for _ in range(seats):
            k = min((k for k in weights if weights[k] > 0), key=lambda k: (-weights[k] / (2 * want[k] + 1), str(k)))
            want[k] += 1
    assert mixing.sainte_lague(weights, seats) == want


def test_shard_quotas_cap():
    assert mixing.shard_quotas([4, 4], 20, 2) == [8, 8] and sum(mixing.shard_quotas([9, 1, 5], 11, 1)) == 11 and mixing.shard_quotas([], 5, 2) == []


def test_mix_shares_and_caps(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(["token"] * rnd.randrange(20, 80)), "en", "big" if i < 1500 else "mid" if i < 1900 else "tiny") for i in range(1950)]
    rows += [(5000, " ".join(["long"] * 6000), "en", "mid"), (5001, None, "en", "big"), (5002, "", None, None), (5003, "no source", "en", None)]
    targets = spark.createDataFrame([("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "tiny", 0.15, 3), ("m", "ghost", 0.05, 2), ("n", "ghost", 1.0, 1), (None, "big", 1.0, 1), ("m", "odd", None, 1)], "mix_name string, source string, target_share double, max_repeats int")
    drawn = mixing.mix(docs(spark, rows), targets, default_vocabulary(), block_tokens=256)
    rep = {(r["mix_name"], r["source"]): r for r in mixing.mix_report(drawn, targets).collect()}
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.15)):
        assert abs(rep[("m", s)]["actual_share"] - share / 0.95) < 0.03
        assert rep[("m", s)]["most_repeats"] <= rep[("m", s)]["max_repeats"]
    assert rep[("m", "ghost")]["n_tokens"] == 0 and rep[("n", "ghost")]["actual_share"] == 0.0
    per = drawn.groupBy("mix_name", "doc_id", "repeat_no").count().where("count > 1").count()
    assert per == 0 and drawn.where("doc_id >= 5001").count() == 0


def test_mix_empty(spark):
    kinds = "mix_name string, source string, target_share double, max_repeats int"
    assert mixing.mix(docs(spark, []), spark.createDataFrame([("m", "a", 1.0, 1)], kinds), default_vocabulary()).count() == 0
    assert mixing.mix(docs(spark, [(1, "text", "en", "a")]), spark.createDataFrame([], kinds), default_vocabulary()).count() == 0


def test_counted_reads_whole_texts(spark):
    df = docs(spark, [(1, "a b c " * 50_000, "en", "s"), (2, None, "en", "s"), (3, "<|endoftext|>", "en", "s")])
    got = {r["doc_id"]: r["n_tokens"] for r in counted(df, ["doc_id"], "text", default_vocabulary()).collect()}
    assert got[1] >= 150_000 and got[2] == 0 and got[3] > 1


def test_shards_hold_equal_tokens(spark):
    from crysmill.llm.packing import placed
    from crysmill.runtime import Scratch

    rows = [(i, i % 40, ["en", None, "de"][i % 3], None if i % 5 == 0 else f"s{i % 2}", 1 + i * 7 % 50) for i in range(600)]
    tokens = spark.createDataFrame(rows, "no bigint, doc_id bigint, lang string, source string, n int")
    ahead = {r["no"]: r["ahead"] for r in placed(tokens, Scratch(spark, "t"), 1).collect()}
    at = sorted((ahead[r[0]], r[4]) for r in rows)
    # every text begins where the one before it ends
    assert [a for a, _ in at] == [sum(n for _, n in at[:i]) for i in range(len(at))]
    assert placed(tokens.limit(0), Scratch(spark, "t"), 1).count() == 0
