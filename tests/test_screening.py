"""The screening rules on invented sentences of the real domain."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import contacts, screening, sheets
from corvane.plans import sweep
from corvane.rules import NEVER, literals, load_rules, make_rules, problems, rules_version
from corvane.sources import harvest, records

RAW = {
    "facility": {"name": "Example"},
    "institutional_sources": [{"name": "repo", "adapter": "dspace7"}, {"name": "portal", "adapter": "pure_oai", "author_list_complete": False}],
    "acknowledgement_patterns": ["example imaging (core|\n   facility)"], "false_positive_contexts": {"affiliation": r"^\d? ?example imaging core, example university", "flowing_software": "flowing software"}, "postal_patterns": r"\b12345 Exampletown\b",
    "network_patterns": ["euro-?bio ?imaging"], "other_local_imaging": [], "microscopy_terms": ["microscop", "confocal"],
    "instruments": {"lsm": {"strength": "weak", "pattern": "LSM ?880", "components": ["airyscan", "zen blue|zen black"]}, "sted": {"strength": "strong", "pattern": "STEDY 5", "exclude": "histology"}},
    "techniques": {"sted": {"vocab": "m", "strength": "specialist", "pattern": "stimulated emission"}}, "other_facilities": ["other imaging unit"], "generic_imaging_facility": "imaging (core|unit)", "not_light_microscopy": "electron microscop",
    "score": {"acknowledgement": 10, "strong_instrument": 4, "component": 1, "component_max": 4, "specialist_technique": 1, "specialist_technique_max": 3, "local_email": 1, "credited_elsewhere": -5, "report": 10, "check": 5, "single_local_author": -2, "many_local_authors": 1,
              "life_science_unit": 1, "non_life_science_field": -3, "review": -3, "preprint": -2, "not_a_paper": -6, "instrument_named_with_exampletown": 1, "instrument_named_elsewhere": -2, "repeat_user": 2, "staff_thanked": 4, "staff_author": 3, "group_booked": 2, "booked_instrument_used": 3},
    "facility_staff": ["Smith, Jane"], "life_science_fields": ["118"], "life_science_units": "biolog", "review_title": r"\breview\b", "dataset_doi_prefixes": ["10.5281/"], "preprint_doi_prefixes": ["10.1101/"], "local_place_words": "exampletown", "other_institution": r"\buniversity\b",
    "local_email_domains": ["example.edu"], "europepmc_search_terms": ["Example Imaging Facility"],
}
RULES = make_rules(RAW)
SCHEMA = "doi string, text string, title string, type string, year int, fields array<string>, units array<string>, local_authors array<string>, sources array<string>, repeat_user boolean, bookings array<struct<year:int,instrument:string>>"
MICRO = " We used a confocal microscope, a confocal microscope and a confocal microscope."


def screened(spark, *rows, staff=()):
    full = [tuple(r.get(c.split(" ")[0]) for c in SCHEMA.split(", ")[:10]) + (r.get("bookings"),) for r in rows]
    return {r.doi: r for r in screening.screen(spark.createDataFrame(full, SCHEMA), RULES, staff).collect()}


def test_categories_and_their_order(spark):
    got = screened(
        spark,
        {"doi": "a", "text": "We thank the Example Imaging Core."}, {"doi": "aff", "text": "1 Example Imaging Core, Example University." + MICRO}, {"doi": "post", "text": "Example Imaging Core, 12345 Exampletown."},
        {"doi": "flow", "text": "Data from Flowing Software of the Example Imaging Core were gated."}, {"doi": "b", "text": "It was a STEDY 5."}, {"doi": "excluded", "text": "A STEDY 5 for histology."}, {"doi": "c", "text": "By stimulated emission." + MICRO, "sources": ["repo"]},
        {"doi": "not local", "text": "By stimulated emission." + MICRO, "sources": ["europepmc_ack"]}, {"doi": "e", "text": "Through EuroBioImaging." + MICRO}, {"doi": "f", "text": MICRO}, {"doi": "g", "text": "Nothing."}, {"doi": "n", "text": " \n "}, {"doi": "n2", "text": None, "sources": ["europepmc_ack"]},
    )
    assert {k: r.category for k, r in got.items()} == {"a": "A", "aff": "D", "post": "D", "flow": "G", "b": "B", "excluded": "G", "c": "C", "not local": "F", "e": "E", "f": "F", "g": "G", "n": "N", "n2": "N"}
    assert got["flow"].flowing_software_only and got["a"].acknowledgement == ["We thank the Example Imaging Core."] and got["aff"].affiliation_only
    assert got["n2"].priority == "check" and got["n2"].score == 5 and got["n"].priority is None and got["a"].evidence and got["f"].evidence == []


def test_components_promote_a_common_instrument_only_near_its_name(spark):
    far = "Airyscan was used with zen blue. " + "Much else was done here. " * 60
    got = screened(spark, {"doi": "near", "text": "An LSM880 with Airyscan and ZEN black."}, {"doi": "far", "text": far + "An LSM 880 stood there."}, {"doi": "one", "text": "An LSM 880 with airyscan, airyscan."})
    assert got["near"].instruments_strong == ["lsm"] and got["near"].fingerprints == {"lsm": ["Airyscan", "ZEN black"]} and got["near"].score == 6 and got["near"].priority == "check"
    assert got["far"].instruments_weak == ["lsm"] and got["far"].fingerprints == {} and got["one"].instruments_weak == ["lsm"] and got["one"].score == 1


def test_every_term_of_the_score(spark):
    base = {"text": "It was a STEDY 5.", "local_authors": ["A, B", "C, D"]}
    rows = [
        {"doi": "plain", **base}, {"doi": "mail", **base, "text": base["text"] + " Write to me@example.edu."}, {"doi": "here", **base, "text": "A STEDY 5 in Exampletown."}, {"doi": "away", **base, "text": "A STEDY 5 of a university."}, {"doi": "three", **base, "local_authors": ["A, B", "C, D", "E, F"]},
        {"doi": "alone", **base, "local_authors": ["A, B"]}, {"doi": "alone2", **base, "local_authors": ["A, B"], "sources": ["portal"]}, {"doi": "unit", **base, "units": ["Dept. of Biology"]}, {"doi": "user", **base, "repeat_user": True}, {"doi": "staff", **base, "text": "A STEDY 5. We thank Jane Smith."},
        {"doi": "field", **base, "fields": ["222"]}, {"doi": "field2", **base, "fields": ["222", "1181"]}, {"doi": "type", **base, "type": "A2 x"}, {"doi": "title", **base, "title": "A Review of it"}, {"doi": "10.1101/x", **base}, {"doi": "10.5281/x", **base, "text": "We thank the Example Imaging Core."},
        {"doi": "credit", **base, "text": "A STEDY 5. We thank the Other Imaging Unit."}, {"doi": "credit em", **base, "text": "A STEDY 5. We thank the other imaging unit for electron microscopy."}, {"doi": "acked", **base, "text": "Thanks to the Example Imaging Core. We thank the Other Imaging Unit.", "fields": ["222"]},
    ]
    got = screened(spark, *rows)
    want = {"plain": 4, "mail": 5, "here": 5, "away": 2, "three": 5, "alone": 2, "alone2": 4, "unit": 5, "user": 6, "staff": 8, "field": 1, "field2": 4, "type": 1, "title": 1, "10.1101/x": 2, "10.5281/x": 4, "credit": -1, "credit em": 4, "acked": 10}
    assert {k: r.score for k, r in got.items()} == want
    assert got["10.5281/x"].priority == "low" and got["acked"].priority == "report" and got["staff"].priority == "check" and got["mail"].score_reasons == ["+4 instrument: sted", "+1 example.edu e-mail"]
    assert got["10.5281/x"].score_reasons == ["+10 acknowledgement", "-6 dataset, not a paper"] and got["three"].score_reasons[-1] == "+1 3 local authors"


def test_private_inputs_never_touch_the_public_score(spark):
    row = {"doi": "p", "text": "A STEDY 5." + MICRO + " We thank Peter Hidden.", "local_authors": ["Hidden, Paul", "B, C"], "year": 2020}
    booked = {**row, "bookings": [(2019, "sted"), (2012, "lsm")]}
    plain, full = screened(spark, row)["p"], screened(spark, booked, staff=("hidden|p",))["p"]
    assert plain.private is None and (plain.score, plain.priority, plain.score_reasons) == (full.score, full.priority, full.score_reasons)
    assert full.private.score == full.score + 3 + 4 + 2 + 3 and full.private.priority == "check"
    assert full.private.reasons == ["+3 facility staff among authors", "+4 facility staff thanked", "+2 group booked the facility", "+3 booked instrument named in paper"]
    early = screened(spark, {**row, "bookings": [(2016, "sted")]})["p"]
    against = screened(spark, {**booked, "text": booked["text"] + " We thank the Other Imaging Unit."})["p"]
    assert early.private is None and against.private is None


def test_papers_without_any_metadata_are_screened(spark):
    got = screening.screen(spark.createDataFrame([("x", "We thank the example imaging facility.")], "doi string, text string"), RULES).first()
    assert (got.category, got.score, got.priority) == ("A", 10, "report")


def test_names_of_corresponding_authors(spark):
    def of(text, *authors):
        return [tuple(c) for c in spark.range(1).select(contacts.corresponding(F.lit(text), F.lit(list(authors)) if authors else F.array().cast("array<string>")).alias("c")).first().c]

    fill = "Nothing to see here. " * 40
    assert of(fill + "Correspondence: j.doe@a.org, " + "and k.roe@a.org. " + fill + "x@b.org", "Jane Doe", "Roe, Kim") == [("Jane Doe", "j.doe@a.org"), ("Kim Roe", "k.roe@a.org")]
    assert of(fill + "x@b.org " + fill * 3) == [("", "x@b.org")] and of("") == [] and of(fill + " info@b.org a@c.png") == []
    assert of("doe@a.org", "Jane Doe", "John Doe") == [("", "doe@a.org")] and of("Corresponding author: Ann Example University, y@a.org") == [("", "y@a.org")]
    assert len(of(fill + " ".join(f"e-mail: p{i}@a.org" for i in range(6)))) == 3


def test_verdicts_are_never_guessed(spark):
    rows = spark.createDataFrame([("d", "maybe", "", "", 0)], "doi string, verdict string, reason string, note string, pos long")
    with pytest.raises(Exception, match="is not one of"):
        sheets.verdicts(rows).collect()
    with pytest.raises(ValueError, match="revisit"):
        sheets.pending(rows, ("perhaps",))
    with pytest.raises(ValueError, match="not in the table"):
        sheets.set_verdict(rows, "other", "yes")


def test_rules_are_checked_and_stamped(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(RAW))
    assert load_rules(path) == RULES
    stamp = rules_version(path)
    path.write_text(json.dumps(RAW, indent=2))
    assert rules_version(path) == stamp
    path.write_text(json.dumps({**RAW, "component_window_chars": 500}))
    assert rules_version(path) != stamp
    assert problems([]) == ["the file holds no settings by name"] and problems(RAW) == []
    assert problems({**RAW, "score": 3, "instruments": None, "local_place_words": "", "institutional_sources": [{"name": "x"}]}) == [
        "instruments: not set", "score: should be a mapping", "local_place_words: not set", "institutional_sources[0]: its adapter is none of ('dspace7', 'pure_oai')",
    ]
    for change, message in (({"score": None}, "score"), ({"institutional_sources": []}, "nothing would be screened"), ({"institutional_fields": "some"}, "institutional_fields"), ({"institutional_sources": [{"name": "x", "adapter": "y"}]}, "adapter"), ({"false_positive_contexts": {}}, "affiliation")):
        with pytest.raises(ValueError, match=message):
            make_rules({k: v for k, v in {**RAW, **change}.items() if v is not None})


def test_a_year_s_sweep_and_rescreen(spark):
    article = "We thank the Example Imaging Core. " + "Words of an article that goes on and on without end. " * 60
    kind = "doi string, title string, year int, type string, fields array<string>, local_authors array<string>, units array<string>"
    repo = spark.createDataFrame([("10.1234/a", "Words of an article", 2020, "A1", ["118"], ["Dataimport, x", "A, B"], []), ("10.1234/b", "Something quite different entirely", 2020, "A1", [], [], []), ("", "none", 2020, "", [], [], [])], kind)
    hits = spark.createDataFrame([("10.1234/c", "Found only there", "PMC1", None)], "doi string, title string, pmcid string, epmc_id string")
    candidates = sweep.collect([("repo", repo)], hits, RULES)
    log = spark.createDataFrame([], "doi string, seq long, has_text boolean")
    held = spark.createDataFrame([], "doi string, text string, scope string, source string")
    offers = spark.createDataFrame([("10.1234/a", "utupub", 0, article, "u", None, None), ("10.1234/b", "utupub", 0, article, "u", None, None)], "doi string, source string, pos int, text string, url string, license string, version string")
    past = spark.createDataFrame([(["A, B"], 2018)], "local_authors array<string>, year int")
    public, private, texts = sweep.sweep(candidates, log, held, offers, past, RULES)
    got = {r.doi: r for r in public.collect()}
    assert {k: r.category for k, r in got.items()} == {"10.1234/a": "A", "10.1234/b": "N", "10.1234/c": "N"} and "+2 repeat facility user group" in got["10.1234/a"].score_reasons and got["10.1234/a"].local_authors == ["A, B"]
    assert got["10.1234/c"].priority == "check" and got["10.1234/c"].sources == ["europepmc_ack"] and private.count() == 0 and [r.doi for r in texts.collect()] == ["10.1234/a"]
    again = sweep.rescreen(public, texts.select("doi", "text"), past, RULES, fresh=spark.createDataFrame([("10.1234/a", "An article of words", [""] * 0)], "doi string, title string, fields array<string>"))
    rows = {r.doi: r for r in again.collect()}
    assert rows["10.1234/a"].title == "An article of words" and rows["10.1234/a"].category == "A" and rows["10.1234/a"].fields == ["118"] and len(rows) == 3


def test_fetching_gives_up_where_it_should():
    answers, waits = [], []

    def opener(url, timeout):
        return answers.pop(0)

    ask = harvest.Fetcher(opener=opener, sleep=waits.append)
    answers[:] = [(500, b"", {}), (429, b"", {"Retry-After": "7"}), (200, b"{}", {})]
    assert ask.json("http://a/x") == {} and waits == [1.0, 7.0]
    answers[:] = [(404, b"", {})]
    assert ask("http://a/x") is None and not answers
    answers[:] = [(429, b"Insufficient budget", {})]
    assert ask("http://a/x") is None and ask("http://a/y") is None and ask.exhausted == {"a"}


def test_filed_papers_are_rewritten_by_year(spark, tmp_path):
    path = str(tmp_path / "papers")
    rows = spark.createDataFrame([("b", "t", 2020, None), ("a", None, 2020, "s"), ("c", "t", 2021, "s")], "doi string, title string, year int, source string")
    records.write_papers(rows, path)
    assert records.years(spark, path) == [2020, 2021]
    records.write_papers(rows.filter("year = 2020"), path)
    assert records.years(spark, path) == [2020] and records.years(spark, str(tmp_path / "none")) == []
    lines = [line for f in (tmp_path / "papers" / "year=2020").glob("*.json") for line in f.read_text().splitlines()]
    assert lines == ['{"doi":"a","source":"s"}', '{"doi":"b","title":"t"}']
    sheets_path = str(tmp_path / "sheet")
    records.write_table(rows.withColumn("extra", F.lit(1)), ("doi", "title"), sheets_path, ["doi"])
    assert [f.read_text() for f in (tmp_path / "sheet").glob("*.csv")] == ["doi,title\na,\nb,t\nc,t\n"]


def test_bookings_and_staff_are_read(spark, tmp_path):
    (tmp_path / "b.csv").write_text("group_leader,instrument,date\n\"Ångström, Zoë\",LSM ,2020-05-01\n,x,2020\n\"A, B\",y,soon\n")
    assert [tuple(r) for r in records.read_bookings(spark, str(tmp_path / "b.csv")).collect()] == [("angstrom|z", 2020, "lsm")]
    (tmp_path / "s.csv").write_text("name\n\"Smith, Jane\"\n\n")
    assert [r.key for r in records.read_staff(spark, str(tmp_path / "s.csv")).collect()] == ["smith|j"]
    assert records.read_or_empty(spark, str(tmp_path / "nothing"), "a int").count() == 0


def test_literals_that_matches_need():
    cases = {
        "thble (of|the)": ("thble ",), "a|bcd": None, "core|facility": ("core", "facility"), "(?:a|bc)def+": ("de",), r"\bSTEDY 5": ("stedy 5",), "x?": None, "abc(def)?": ("abc",), "(abc)+d{2,}": ("abc",), "light[- ]sheet": ("light",), "(?!x)x": None,
        r"(imag(e|ing)|foo) (core|unit)": None, "(?=abcdef)ghi": ("ghi",), r"\p{L}+abc": None, "Åbo akademi": ("bo akademi",), "(?-i:LSM) ?880": ("lsm",), ".*": None, "": None,
    }
    assert {p: literals(p) for p in cases} == {**cases, "(?:a|bc)def+": None, r"(imag(e|ing)|foo) (core|unit)": ("core", "unit")}


def test_a_plain_search_rules_out_no_match(spark):
    rng = random.Random(12)
    patterns = [i.pattern for i in RULES.instruments] + [RULES.acknowledgement, RULES.generic_facility, RULES.microscopy, RULES.other_institution, "skin|kiosk", "(sis|kik)+i", NEVER]
    pieces = ["airy", "LSM", " 880", "lsm880", "STEDY", " 5", "ﬁ", "\u017fKI\u0130", "s\u0131s", "\u212aIK", "k\u0131os\u212a", "\u017fis", "i", "example imaging ", "core", "Facility", "micro\u017fcop", "univer\u017fity", "İ", "ß", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for p in patterns:
        row = df.agg(F.count_if(screening.has(F.col("t"), p)).alias("all"), F.count_if(screening.has(F.col("t"), p) & ~screening.may(screening.folded(F.col("t")), p)).alias("lost")).first()
        assert row.lost == 0 and (p == NEVER or literals(p) is not None)
    assert df.filter(screening.has(F.col("t"), "skin|kiosk")).count() and df.filter(screening.has(F.col("t"), "(sis|kik)+i")).count()


def test_private_rows_are_the_screened_ones_and_cost_one_look(spark):
    text = "We thank the Example Imaging Core. Confocal microscopy, confocal microscopy, confocal microscopy and confocal microscopy were used."
    rows = [(f"d{i}", text if i % 2 else "Nothing.", 2020, ["A, B"], [(2020 - i, "scope")] if i % 3 else None) for i in range(12)]
    papers = spark.createDataFrame(rows, "doi string, text string, year int, local_authors array<string>, bookings array<struct<year:int,instrument:string>>")
    for staff in ((), ("a|b",)):
        whole = screening.screen(papers, RULES, staff)
        want = {r.doi: r.private for r in whole.collect() if r.private}
        got = screening.private_rows(papers, RULES, staff).select("doi", "private")
        assert {r.doi: r.private for r in got.collect()} == want and len(want) == (12 if staff else len(want))
        assert {r.doi: r.score for r in screening.split_private(whole)[1].collect()} == {d: p.score for d, p in want.items()}
        assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") < 20
