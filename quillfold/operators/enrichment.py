"""What outside tables know of a case: Supreme Court database, justices' scores, rosters of circuit judges.

Lookups join by key and decide by counts; a case's candidates are never collected. Reference tables are broadcast only where `small` has counted them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfold.functions.columns import blank_to_null, circuit_key, classify_score, docket_tokens, initials_conflict, initials_ok, norm_cite, norm_name_tight, parse_date, parse_initials, year
from quillfold.functions.names import first_token, fold, initials_of_name, last_keys, surname_variants
from quillfold.functions.opinions import author as author_of
from quillfold.functions.opinions import signed_as_district
from quillfold.operators.relational import active_pairs, cut_lineage, latest_of, override, small, whole_spans

# The columns that the Supreme Court step clears and fills, and how parties are told.
DATABASE_FIELDS = ["scdb_id", "issue_area", "issue_area_source", "decision_direction", "ideology_score", "ideology_source"]
CIRCUITS = {"CA5": ("5", "fifth"), "CA9": ("9", "ninth")}
PARTIES = {"republican": "R", "democratic": "D", "democrat": "D"}


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


# Loaders of reference tables.


def justice_scores(raw: DataFrame) -> DataFrame:
    """justice, term, post_mn as numbers; rows where one is no number are skipped, of repeated ones the last by value stays."""
    numbers = raw.select(F.col("justice").try_cast("int").alias("justice"), F.col("term").try_cast("int").alias("term"), F.col("post_mn").try_cast("double").alias("post_mn"))
    return numbers.where("justice IS NOT NULL AND term IS NOT NULL AND post_mn IS NOT NULL").groupBy("justice", "term").agg(F.max("post_mn").alias("post_mn"))


def circuit_roster(raw: DataFrame) -> DataFrame:
    """first_name, full_name, last, court, initials, score of roster rows that have a surname and a score."""
    first, last = F.trim(_text("`first.name`")), F.trim(_text("`last.name`"))
    rows = raw.select(first.alias("first_name"), F.trim(F.concat_ws(" ", first, last)).alias("full_name"), fold(last).alias("last"), F.trim(_text("court")).alias("court"), initials_of_name(first).alias("initials"), F.col("judjis").try_cast("double").alias("score"), (last != "").alias("named"))
    return rows.where("named AND score IS NOT NULL").drop("named")


def appeals_scores(raw: DataFrame) -> DataFrame:
    """court, surname, holder, first, initials, score, one row for each key of a surname; `Last, First` is taken apart."""
    name, circuit = F.col("name"), F.col("circuit").try_cast("double").try_cast("int")
    rest = F.regexp_extract(name, r"(?s)^[^,]*,(.*)$", 1)
    rows = raw.select(circuit.cast("string").alias("court"), F.explode(last_keys(F.substring_index(name, ",", 1))).alias("surname"), name.alias("holder"), first_token(rest).alias("first"), initials_of_name(rest).alias("initials"), F.col("jcs").try_cast("double").alias("score"))
    return rows.where("court IS NOT NULL AND score IS NOT NULL")


def appointments(raw: DataFrame, slots: Sequence[int] | None = None) -> DataFrame:
    """One row for each filled appointment of a biography: person, surname keys, first name, initials, court, dates, party.

    The slots are those that the header has.
    """
    found = sorted({int(c[len("Court Name (") : -1]) for c in raw.columns if c.startswith("Court Name (") and c.endswith(")")})
    cell = lambda name, k: _text(f"`{name} ({k})`") if f"{name} ({k})" in raw.columns else F.lit("")
    entry = lambda k: F.struct(F.lit(k).alias("slot"), F.trim(cell("Court Name", k)).alias("court"), parse_date(F.trim(cell("Commission Date", k))).alias("start"), parse_date(F.trim(cell("Termination Date", k))).alias("end"), F.trim(cell("Party of Appointing President", k)).alias("raw_party"))
    party = F.create_map(*[F.lit(x) for pair in PARTIES.items() for x in pair])
    person = F.coalesce(blank_to_null(F.col("nid")), F.concat_ws("|", _text("`Last Name`"), _text("`First Name`")))
    rows = raw.select(person.alias("person"), _text("`Last Name`").alias("last_name"), last_keys(F.col("`Last Name`")).alias("keys"), first_token(F.col("`First Name`")).alias("first"), initials_of_name(F.col("`First Name`"), F.col("`Middle Name`")).alias("initials"), F.explode(F.array(*[entry(k) for k in (slots or found)])).alias("a"))
    return rows.where("a.court <> ''").select("person", "last_name", "keys", "first", "initials", "a.*").withColumn("party", F.coalesce(F.try_element_at(party, F.lower("raw_party")), F.lit("")))


def circuit_appointments(raw: DataFrame, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """circuit, surname, person, initials, start, end of appointments to the two courts of appeals that overlap [lo, hi]; open ends overlap."""
    court = F.lower("court")
    circuit = F.coalesce(*[F.when(court.contains(word), key) for key, word in CIRCUITS.values()])
    rows = appointments(raw, range(1, 7)).withColumn("circuit", circuit).where(F.col("circuit").isNotNull() & court.contains("court of appeals"))
    for early, late in ((F.col("start"), hi), (lo, F.col("end"))):
        if early is not None and late is not None:
            rows = rows.where(F.coalesce(early <= late, F.lit(True)))
    return rows.select("circuit", fold(F.col("last_name")).alias("surname"), "person", "initials", "start", "end")


# Supreme Court.


def docket_numbers(cases: DataFrame, clusters: DataFrame, dockets: DataFrame) -> DataFrame:
    """cluster_id, docket_number and the id that the bulk data names, of the cases only: case to docket to its number."""
    wanted = cases.select(F.col("cluster_id").cast("string").alias("cluster_id")).distinct()
    of_case = clusters.select(F.trim("id").alias("cluster_id"), F.trim("docket_id").alias("docket_id"), F.trim(_text("scdb_id")).alias("named_id")).join(wanted, "cluster_id", "left_semi")
    of_docket = dockets.select(F.trim("id").alias("docket_id"), _text("docket_number").alias("docket_number"))
    return of_case.join(of_docket.join(of_case.select("docket_id"), "docket_id", "left_semi"), "docket_id", "left").select("cluster_id", "named_id", F.coalesce("docket_number", F.lit("")).alias("docket_number"))


def first_citations(cases: DataFrame, citations: DataFrame, order: str) -> DataFrame:
    """cluster_id and its first citation of the United States Reports, in the file's order."""
    cite = norm_cite(F.col("volume"), F.col("page"))
    rows = citations.where(F.trim("reporter") == "U.S.").select(F.trim("cluster_id").alias("cluster_id"), cite.alias("cite"), order).where("cite <> ''")
    rows = rows.join(cases.select(F.col("cluster_id").cast("string").alias("cluster_id")), "cluster_id", "left_semi")
    return rows.groupBy("cluster_id").agg(F.min_by("cite", order).alias("cite"))


def match_database(cases: DataFrame, numbers: DataFrame, cites: DataFrame, database: DataFrame, order: str) -> DataFrame:
    """cluster_id, method (docket, uscite, name_year, none) and the matching row of the database as a struct `hit`.

    A docket has all rows under it, of which the first is taken; of several tokens of a case the smallest known one; of
    citations and names (with the year) the first row counts. database: docket, usCite, caseId, caseName, dateDecision and more.
    """
    whole = F.struct(*[c for c in database.columns])
    tokens = database.select(F.explode(docket_tokens(F.col("docket"))).alias("token"), order, whole.alias("hit")).groupBy("token").agg(F.min_by("hit", order).alias("hit"))
    by_cite = database.select(F.replace(F.trim("usCite"), F.lit(" "), F.lit("")).alias("cite"), order, whole.alias("hit")).where("cite <> ''").groupBy("cite").agg(F.min_by("hit", order).alias("by_cite"))
    by_name = database.select(norm_name_tight(F.col("caseName")).alias("name"), F.coalesce(year(F.col("dateDecision")), F.lit("")).alias("year"), order, whole.alias("hit")).groupBy("name", "year").agg(F.min_by("hit", order).alias("by_name"))
    rows = cases.select(F.col("cluster_id").cast("string").alias("cluster_id"), norm_name_tight(F.col("case_name")).alias("name"), F.coalesce(year(F.col("date_filed")), F.lit("")).alias("year")).join(numbers, "cluster_id", "left").join(cites, "cluster_id", "left")
    of_docket = rows.select("cluster_id", F.explode(docket_tokens(F.col("docket_number"))).alias("token")).join(small(tokens), "token").groupBy("cluster_id").agg(F.min_by("hit", "token").alias("by_docket"))
    joined = rows.join(of_docket, "cluster_id", "left").join(small(by_cite), "cite", "left").join(small(by_name), ["name", "year"], "left")
    method = F.when(F.col("by_docket").isNotNull(), "docket").when(F.col("by_cite").isNotNull(), "uscite").when(F.col("by_name").isNotNull(), "name_year").otherwise("none")
    agrees = lambda hit: F.when((F.coalesce("named_id", F.lit("")) != "") & hit.isNotNull(), hit["caseId"] == F.col("named_id"))
    hit = F.coalesce("by_docket", "by_cite", "by_name")
    return joined.select("cluster_id", method.alias("method"), hit.alias("hit"), agrees(hit).alias("agrees"))


def enrich_supreme(cases: DataFrame, matched: DataFrame, scores: DataFrame) -> DataFrame:
    """cases with DATABASE_FIELDS cleared and filled again from their match; the justice's score by author and term."""
    hit = matched.select("cluster_id", "hit")
    number = lambda c: F.col(f"hit.{c}").try_cast("int")
    keyed = hit.withColumn("justice", number("majOpinWriter")).withColumn("term", number("term"))
    scored = keyed.join(small(justice_scores(scores)), ["justice", "term"], "left").drop("justice", "term")
    supreme = F.col("jurisdiction") == "SCOTUS"
    area = F.trim(F.coalesce("hit.issueArea", F.lit("")))
    filled = {
        "scdb_id": F.col("hit.caseId"),
        "issue_area": area,
        "issue_area_source": F.when(area != "", "scdb"),
        "decision_direction": F.trim("hit.decisionDirection"),
        "ideology_score": F.col("post_mn").cast("string"),
        "ideology_source": F.when(F.col("post_mn").isNotNull(), "martin_quinn"),
    }
    keep = [c for c in cases.columns if c not in DATABASE_FIELDS]
    old = lambda c: _text(c) if c in cases.columns else F.lit("")
    joined = cases.withColumn("_id", F.col("cluster_id").cast("string")).join(scored.withColumnRenamed("cluster_id", "_id"), "_id", "left")
    return joined.select(*keep, *[F.when(supreme, F.coalesce(value, F.lit(""))).otherwise(old(c)).alias(c) for c, value in filled.items()])


# Authors and their ideology.


def with_authors(rows: DataFrame, corrections: DataFrame | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """author_str, author_source, author_initials of circuit opinions, corrections (cluster_id, author_str, author_initials) on top."""
    circuit = F.col("jurisdiction").isin(*CIRCUITS)
    fields = {"author_str": "author", "author_source": "author_source", "author_initials": "initials"}
    rest = [c for c in rows.columns if c not in fields]
    out = rows.withColumn("_a", F.when(circuit, author_of(F.col("opinion_text"))))
    old = lambda c: _text(c) if c in rows.columns else F.lit("")
    out = out.select(*rest, *[F.when(circuit, F.col(f"_a.{field}")).otherwise(old(c)).alias(c) for c, field in fields.items()])
    if corrections is None:
        return out
    last = latest_of(corrections, "cluster_id", order or [F.struct(*corrections.columns)])
    named = last.select(F.col("cluster_id").cast(rows.schema["cluster_id"].dataType).alias("cluster_id"), F.trim(_text("author_str")).alias("author_str"), F.trim(_text("author_initials")).alias("author_initials"), F.lit("manual").alias("author_source"))
    return override(out.where(circuit), named, "cluster_id").unionByName(out.where(~F.coalesce(circuit, F.lit(False))))


def _active_initials(sought: DataFrame, people: DataFrame) -> DataFrame:
    """q, p_initials, weight: how many persons with these initials are active at each question (all of the names without a date).

    Persons of one surname and initials in a circuit are counted by their spans; the few who bear several meet questions one by one.
    """
    key, cells = ["circuit", "surname"], ["circuit", "surname", "p_initials"]
    people = people.withColumnRenamed("initials", "p_initials").where("person IS NOT NULL")
    several = people.groupBy("circuit", "person").agg(F.count_distinct("surname", "p_initials").alias("_n")).where("_n > 1").select("circuit", "person")
    one, more = people.join(several, ["circuit", "person"], "left_anti"), people.join(several, ["circuit", "person"], "left_semi")
    undated = sought.where("date IS NULL")
    spans = whole_spans(one, cells).drop("person")
    counted = active_pairs(sought, spans, key).select("q", "p_initials", "n")
    ever = undated.join(small(one.groupBy(*cells).agg(F.count_distinct("person").alias("n"))), key).select("q", "p_initials", "n")
    single = active_pairs(sought, more, key).unionByName(undated.join(small(more), key))
    single = single.groupBy("q", "person").agg(F.max_by("p_initials", F.struct("start", "p_initials")).alias("p_initials")).select("q", "p_initials", F.lit(1).cast("long").alias("n"))
    return counted.unionByName(ever).unionByName(single).withColumnRenamed("n", "weight")


def _asked(cases: DataFrame) -> DataFrame:
    """cases with q, the question that a case asks of roster and biographies (null: none): its circuit, date, initials and names."""
    initials = parse_initials(F.coalesce("initials", F.lit("")))
    own = F.when(circuit_key(F.col("court")) != "", circuit_key(F.col("court"))).otherwise(circuit_key(F.col("jurisdiction")))
    asks = (F.trim(F.coalesce("author", F.lit(""))) != "") & ~F.coalesce("district", F.lit(False))
    question = F.struct(own.alias("circuit"), F.col("date"), initials.alias("initials"), F.array_join(surname_variants(F.col("author"), F.col("jurisdiction")), "|").alias("names"))
    return cases.withColumn("q", F.when(asks, F.to_json(question, {"ignoreNullFields": "false"})))


def _roster_counts(asked: DataFrame, roster: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each question of `asked` with candidates of the roster: n persons active on its date and the initials of the one chosen, rows and n_ok of the candidates; and the names sought.

    Cases that ask the same are one question, and roster rows and persons that answer alike are counted before they meet it.
    """
    questions = asked.where("q IS NOT NULL").select("q", F.from_json("q", "circuit string, date date, initials string, names string").alias("_a")).groupBy("q").agg(F.first("_a").alias("_a"))
    questions = cut_lineage(questions).select("q", "_a.circuit", "_a.date", "_a.initials", F.explode(F.array_distinct(F.split("_a.names", r"\|"))).alias("surname"))
    held = roster.select("last", "full_name", "score", F.col("court").alias("r_court"), F.col("initials").alias("r_initials"), circuit_key(F.col("court")).alias("r_circuit")).dropDuplicates(["full_name", "r_court"])
    alike = held.groupBy(F.col("last").alias("surname"), "r_circuit", "r_initials").agg(F.count(F.lit(1)).alias("_rows"), F.max(F.struct("full_name", "score")).alias("_last"))
    fits_court = (F.col("circuit") == "") | (F.col("r_circuit") == "") | (F.col("circuit") == F.col("r_circuit"))
    candidates = questions.join(small(alike), "surname").where(fits_court)
    persons = _active_initials(questions, people).join(questions.select("q", "initials").distinct(), "q")
    fit = (F.col("initials") != "") & initials_ok(F.col("initials"), F.col("p_initials"))
    there = persons.groupBy("q").agg(F.sum("weight").alias("n"), F.sum(F.when(fit, F.col("weight")).otherwise(0)).alias("n_fit"), F.min("p_initials").alias("one"), F.min(F.when(fit, F.col("p_initials"))).alias("fit"))
    there = there.select("q", "n", F.when(F.col("n") == 1, F.col("one")).when(F.col("n_fit") == 1, F.col("fit")).alias("target"))
    joined = candidates.join(there, "q", "left")
    by_person, alone = F.col("n").isNotNull(), F.col("initials")
    ok = F.when(by_person, F.col("target").isNotNull() & initials_ok(F.col("target"), F.col("r_initials"))).otherwise((alone != "") & initials_ok(alone, F.col("r_initials")))
    counts = joined.groupBy("q").agg(F.max("n").alias("n"), F.max("target").alias("target"), F.max("initials").alias("initials"), F.sum("_rows").alias("rows"), F.sum(F.when(ok, F.col("_rows")).otherwise(0)).alias("n_ok"), F.max(initials_conflict(alone, F.col("r_initials"))).alias("clash"), F.max("_last").alias("any"), F.max(F.when(ok, F.col("_last"))).alias("ok"))
    return counts, questions


def roster_matches(cases: DataFrame, roster: DataFrame, people: DataFrame) -> DataFrame:
    """row_id, full_name, score, state of the roster's judge who is the author.

    cases: row_id, author, court, jurisdiction, date, initials, district. roster: see circuit_roster. people: see circuit_appointments.
    One active person decides whatever the initials, and must fit just one roster row; several need initials that fit one
    of them; without any, the roster alone decides: a single row unless its initials clash, several if the initials fit one.
    """
    asked = _asked(cases)
    counts, _ = _roster_counts(asked, roster, people)
    single = F.col("n").isNull() & (F.col("rows") == 1) & ~F.col("clash")
    several = (F.col("n").isNotNull() | (F.col("rows") > 1)) & (F.col("n_ok") == 1)
    state = F.when(single, "roster_only").when(several, "found").when(F.col("n").isNull() & (F.col("rows") == 1), "conflict").otherwise("ambiguous")
    decided = cut_lineage(counts.select("q", F.when(single, F.col("any")).when(several, F.col("ok")).alias("hit"), state.alias("state")))
    return asked.select("row_id", "q").join(small(decided), "q").select("row_id", "hit.full_name", "hit.score", "state")


def roster_reasons(cases: DataFrame, roster: DataFrame, people: DataFrame, *keep: str) -> DataFrame:
    """row_id (with the columns `keep` of its case) and why each case has the author that it has, or none.

    no_author, district (signed as a district judge), no_candidate (the roster has nobody of the name). One active person: active, or date
    where others of the name were not active; several: initials, or several / several_initials where these decide nothing; not_in_roster
    where the person fits no single roster row. Nobody active: roster_only, roster_conflict, roster_initials, roster_several.
    """
    asked = _asked(cases)
    counts, sought = _roster_counts(asked, roster, people)
    # How many persons bear the name: for each name their number and one of them, so that rows meet no list of persons.
    borne = people.groupBy("circuit", "surname").agg(F.count_distinct("person").alias("_n"), F.min("person").alias("_one"))
    names = sought.join(small(borne), ["circuit", "surname"]).groupBy("q").agg((F.max("_n") > 1).alias("_many"), F.count_distinct("_one").alias("_ones"))
    names = names.select("q", (F.col("_many") | (F.col("_ones") > 1)).alias("others"))
    n, found = F.col("n"), F.col("n_ok") == 1
    one = F.when(~found, "not_in_roster").when(F.coalesce("others", F.lit(False)), "date").otherwise("active")
    more = F.when(F.col("target").isNull(), F.when(F.col("initials") != "", "several_initials").otherwise("several")).when(found, "initials").otherwise("not_in_roster")
    none = F.when(F.col("rows") == 1, F.when(F.col("clash"), "roster_conflict").otherwise("roster_only")).when(found, "roster_initials").otherwise("roster_several")
    reason = F.when(n == 1, one).when(n > 1, more).otherwise(none)
    decided = cut_lineage(counts.join(names, "q", "left").select("q", reason.alias("_reason")))
    blank = F.trim(F.coalesce("author", F.lit(""))) == ""
    why = F.when(blank, "no_author").when(F.coalesce("district", F.lit(False)), "district").otherwise(F.coalesce("_reason", F.lit("no_candidate")))
    return asked.select(*cases.columns, "q").join(small(decided), "q", "left").select("row_id", *keep, why.alias("reason"))


def enrich_circuits(rows: DataFrame, roster: DataFrame, people: DataFrame) -> DataFrame:
    """rows with ideology, ideology_score and ideology_source of circuit opinions cleared and filled again from the roster."""
    circuit = F.col("jurisdiction").isin(*CIRCUITS)
    fields = ["ideology", "ideology_score", "ideology_source"]
    cases = rows.where(circuit).select(F.col("cluster_id").alias("row_id"), F.col("author_str").alias("author"), "court", "jurisdiction", parse_date(F.col("date_filed")).alias("date"), F.col("author_initials").alias("initials"), signed_as_district(F.col("opinion_text"), F.col("author_str")).alias("district"))
    found = roster_matches(cases, circuit_roster(roster), people).where("score IS NOT NULL").select(F.col("row_id").alias("cluster_id"), F.col("score").alias("_score"))
    old = lambda c: _text(c) if c in rows.columns else F.lit("")
    new = {"ideology": classify_score(F.col("_score")), "ideology_score": F.coalesce(F.col("_score").cast("string"), F.lit("")), "ideology_source": F.when(F.col("_score").isNotNull(), "judjis").otherwise("")}
    return rows.join(found, "cluster_id", "left").select(*[c for c in rows.columns if c not in fields], *[F.when(circuit, new[c]).otherwise(old(c)).alias(c) for c in fields])
