from loomspan.llm import mojibake as M

CLEAN = [
    "Während der Messung änderte sich die Temperatur für kurze Zeit.", "Le sujet a été acquis après le déplacement moyen.", "Испытуемый сместил голову на несколько миллиметров.", "The lag τ = 4 gave a ≈ 5.4 value – stays “provisional”.",
    "A região não tem cobertura suficiente; a média das sessões é baixa.", "SÃO necessárias execuções. REVISÃO da sessão.", "Labels Ø, Æ and Å in the table.", r"The viewer prints \xc3\xa9 and %C2%B5 literally.", "Η σύζευξη εκτιμήθηκε με επαναλήψεις.",
    "Następnie się powtórzyć należy między sesjami.", "signalé́ par l’étape précédente à l’arrêt", "領域の被覆率は低かった。", "plain ascii", "", None,
]
GARBLED = [
    CLEAN[0].encode().decode("latin-1"), CLEAN[1].encode().decode("cp1252"), CLEAN[3].encode().decode("mac_roman"), CLEAN[2].encode("cp1251").decode("cp1252"), CLEAN[1].encode("cp1252").decode("mac_roman"), CLEAN[0].encode().decode("cp437"),
    CLEAN[1].encode().decode("cp1252").encode().decode("cp1252"), "W�hrend der Messung", CLEAN[9].encode("cp1250").decode("cp1252"), CLEAN[4] + " " + CLEAN[1].encode().decode("cp1252"),
    "領域の" + "被覆率は低かった。".encode().decode("latin-1"),
]


def frame(spark, copies=12):
    rows = [(n * 100 + k, t) for k, t in enumerate(CLEAN) for n in range(copies)] + [(10_000 + k, t) for k, t in enumerate(GARBLED)]
    return spark.createDataFrame([(i, t, "w", 1) for i, t in rows + rows[-3:]], "doc_id long, text string, word string, place int")


def ids(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return M.p8_found(spark, str(tmp_path)), M.p8_restored(spark, str(tmp_path))


def test_found_and_restored(spark, tmp_path):
    found, restored = ids(spark, tmp_path, frame(spark))
    got = [r.doc_id for r in found.collect()]
    assert sorted(got) == [10_000 + k for k in range(len(GARBLED))]
    back = {r.doc_id - 10_000: r for r in restored.collect()}
    assert [back[k].restored for k in (0, 1, 2, 3, 4, 5, 6, 8)] == [CLEAN[k] for k in (0, 1, 3, 2, 1, 0, 1, 9)]
    assert back[9].restored == CLEAN[4] + " " + CLEAN[1] and back[10].restored == CLEAN[11] and back[7].complete is False and back[0].complete


def test_nothing_garbled(spark, tmp_path):
    found, restored = ids(spark, tmp_path, frame(spark).where("doc_id < 10000"))
    assert found.count() == 0 and restored.count() == 0


def test_empty(spark, tmp_path):
    found, restored = ids(spark, tmp_path, frame(spark).where("false"))
    assert found.count() == 0 and restored.count() == 0


def test_repair_and_alignment():
    assert M.repair("fÃ¼r", "utf-8", "cp1252") == "für" and M.repair("für", "utf-8", "cp1252") is None
    assert M.align("AusreiÃŸer", "Ausreißer") == [("ÃŸ", "ß")] and M.align("abc", "abd é") == []
    assert not M.telling("utf-8>mac_roman", M.repair("l’étape", "utf-8", "mac_roman"))
    assert M.repair("café”…", "utf-8", "cp1252") and not M.telling("utf-8>cp1252", M.repair("café”…", "utf-8", "cp1252"))
    assert M.telling("shift_jis>cp1252", "領域の被覆率は低かった")


def test_very_long_text(spark, tmp_path):
    long = " ".join(["wort größer"] * 50_000)
    rows = [(1, long), (2, long.encode().decode("latin-1")), (3, "größer " * 3)]
    found, _ = ids(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in found.collect()] == [2]


def test_copies_of_one_garbled_text(spark, tmp_path):
    rest = ["Испытуемый сместил голову влево.", "Сигнал сместил средний уровень на несколько единиц.", "Снова сместил голову на место."]
    wrong = (CLEAN[2] + " Повторное измерение прошло.").encode("cp1251").decode("cp1252")
    alone = "Калибровка завершена успешно.".encode("cp1251").decode("cp1252")
    rows = [(k, t) for k, t in enumerate([*CLEAN, CLEAN[2] + " Дважды.", *rest]) if t != wrong] + [(1000 + k, wrong) for k in range(200)] + [(5000, alone)]
    found, restored = ids(spark, tmp_path, spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in found.collect()) == [*range(1000, 1200), 5000]
    assert {r.doc_id: r.restored for r in restored.collect()}[5000] == "Калибровка завершена успешно."


def test_one_script():
    assert M.one_script("Êàëèáðîâêà", "Калибровка") and not M.one_script("Калибровка", "Êàëèáðîâêà") and not M.one_script("────", "дддд") and not M.one_script("прогон", "∩≡επεφ")
