"""Sentences, names and numbers of other make than the test tables': recall and precision per kind.

The models are fitted on the documents of the test tables only, with their list of names and a few
common given names; none of these sentences, family names or number formats takes part.
"""

import os

import pytest
from conftest import DATA

from loomspan.llm import personal as P

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
GIVEN = "Maria John Wei Fatima Pierre Elena David Ahmed Sofia Kenji Laura Michael".split()
#: (text, spans that must come out); what else comes out is wrong
CASES = [
    ("Thanks to Maria Gonzalez for the first draft.", {("person", "Maria Gonzalez")}),
    ("Dear John Williams,\nthe parcel arrived.", {("person", "John Williams")}),
    ("The seeds came from Wei Zhang last spring.", {("person", "Wei Zhang")}),
    ("Prof. Katherine Johnson gave the talk.", {("person", "Katherine Johnson")}),
    ("Dr. H. Nakamura signed the form.", {("person", "H. Nakamura")}),
    ("Kind regards,\nPierre Dubois", {("person", "Pierre Dubois")}),
    ("Reviewed by Elena Petrova and filed.", {("person", "Elena Petrova")}),
    ("The plan was made with David van der Berg in May.", {("person", "David van der Berg")}),
    ("Mrs Amina Diallo called twice.", {("person", "Amina Diallo")}),
    ("Author: Kenji Tanaka", {("person", "Kenji Tanaka")}),
    ("We met Laura J. Fischer at the station.", {("person", "Laura J. Fischer")}),
    ("On behalf of Michael O'Brien, please confirm.", {("person", "Michael O'Brien")}),
    ("Hello Sofia Rossi, how are you?", {("person", "Sofia Rossi")}),
    ("Contact: Ahmed Hassan", {("person", "Ahmed Hassan")}),
    ("Collected by Fatima Khan near the bridge.", {("person", "Fatima Khan")}),
    ("You can reach me at 415 555 2671 after lunch.", {("phone", "415 555 2671")}),
    ("Toll free: 1-800-555-0199.", {("phone", "1-800-555-0199")}),
    ("Phone: +1 212 555 0187", {("phone", "+1 212 555 0187")}),
    ("Mobile +49 171 5550123 or by mail.", {("phone", "+49 171 5550123")}),
    ("Call (020) 7946 0011 for keys.", {("phone", "(020) 7946 0011")}),
    ("Dial 617.555.0134 on weekdays.", {("phone", "617.555.0134")}),
    ("Tel. 01 42 68 53 00", {("phone", "01 42 68 53 00")}),
    ("WhatsApp: +91 98765 43210", {("phone", "+91 98765 43210")}),
    ("My SSN 078051120 is on the form.", {("id_number", "078051120")}),
    ("SSN: 219-09-9999", {("id_number", "219-09-9999")}),
    ("Aadhaar number 2345 6789 0123 was recorded.", {("id_number", "2345 6789 0123")}),
    ("CPF 123.456.789-09 is valid.", {("id_number", "123.456.789-09")}),
    ("Passport number: 533380006", {("id_number", "533380006")}),
    ("passport X4RTBPFW was shown; the older one, P1234567, expired", {("id_number", "P1234567")}),
    ("National insurance number AB 12 34 56 C", {("id_number", "AB 12 34 56 C")}),
    ("DNI 12345678Z", {("id_number", "12345678Z")}),
    ("Personnummer: 811228-9874", {("id_number", "811228-9874")}),
    ("She lives at 12345 Main Street since June.", {("address", "12345 Main Street")}),
    ("Deliver to 3 Elm Circle, please.", {("address", "3 Elm Circle")}),
    ("Home address: 221B Baker Street", {("address", "221B Baker Street")}),
    ("Address: 1600 Pennsylvania Avenue", {("address", "1600 Pennsylvania Avenue")}),
    ("Ship the plates to 48 Orchard Parkway, Suite 5", {("address", "48 Orchard Parkway")}),
    ("Adresse: 5 rue de la Paix", {("address", "5 rue de la Paix")}),
    ("Er wohnt Hauptstraße 17", {("address", "Hauptstraße 17")}),
    ("Anschrift: Lindenweg 4a", {("address", "Lindenweg 4a")}),
    ("Write to j.smith99@mail.example.com today.", {("email", "j.smith99@mail.example.com")}),
    ("Mail: maria dot gonzalez at post dot example", {("email", "maria dot gonzalez at post dot example")}),
    ("Reach us: info-desk@uni.example", {("email", "info-desk@uni.example")}),
    ("wei.zhang [at] lab [dot] example [dot] edu", {("email", "wei.zhang [at] lab [dot] example [dot] edu")}),
    ("k_tanaka(at)institute.example", {("email", "k_tanaka(at)institute.example")}),
    # written after the patterns were fixed; what they miss stays missed
    ("The manuscript was edited by Nadia Benali and Tomás Herrera.", {("person", "Nadia Benali"), ("person", "Tomás Herrera")}),
    ("Talk to Grace Hopper if the door is locked.", {("person", "Grace Hopper")}),
    ("GARCIA, Maria (lab 3)", {("person", "GARCIA, Maria")}),
    ("cc: Elena Petrova, Oliver Stone", {("person", "Elena Petrova"), ("person", "Oliver Stone")}),
    ("Sincerely, Dr Yuki Sato", {("person", "Yuki Sato")}),
    ("Ms. Chen Li will attend.", {("person", "Chen Li")}),
    ("the samples of Michael Brown were relabelled", {("person", "Michael Brown")}),
    ("Fax 0049 30 901820", {("phone", "0049 30 901820")}),
    ("my number is 07700 900123", {("phone", "07700 900123")}),
    ("Telefon 089-1234567", {("phone", "089-1234567")}),
    ("ring 555-0147 for the porter", {("phone", "555-0147")}),
    ("Call +33 1 42 68 53 00.", {("phone", "+33 1 42 68 53 00")}),
    ("social security no. 123 45 6789", {("id_number", "123 45 6789")}),
    ("Ausweisnummer: L01X00T47", {("id_number", "L01X00T47")}),
    ("NIE X-1234567-L", {("id_number", "X-1234567-L")}),
    ("identity card number 960820-12345", {("id_number", "960820-12345")}),
    ("Please send it to 77 Massachusetts Ave, Cambridge", {("address", "77 Massachusetts Ave")}),
    ("Via Garibaldi 12, second floor", {("address", "Via Garibaldi 12")}),
    ("we moved to 9 Old Mill Lane", {("address", "9 Old Mill Lane")}),
    ("lives in Calle de Alcalá, 50", {("address", "Calle de Alcalá, 50")}),
    ("Keizersgracht 174", {("address", "Keizersgracht 174")}),
    ("a_b-c+d@sub.mail.example", {("email", "a_b-c+d@sub.mail.example")}),
    ("<laura@post.example>, please reply", {("email", "laura@post.example")}),
    ("name AT host DOT example", {("email", "name AT host DOT example")}),
    ("Sierra Nevada and Lake Baikal were visited.", set()),
    ("The Kruskal Wallis rank test was used by New England labs.", set()),
    ("Batch 2345 6789 0123 was discarded.", set()),
    ("Interval 12-345-6789 is masked", set()),
    ("Chapter 12 Main Findings Road Map", set()),
    ("mail merge at line dot five fails", set()),
    # none of these is personal
    ("Thanks to Green Valley for the compost.", None),
    ("The Mann Whitney test gave p = 0.03.", set()),
    ("Order 4155552671 shipped in 3 boxes.", set()),
    ("Version 1.800.555 of the tool is out.", set()),
    ("Lot 078051120 failed the check.", set()),
    ("We walked down Main Street for an hour.", set()),
    ("Rows 12345 to 12399 belong to Block Seven.", set()),
    ("On 2023-11-05 12:30:11 the run ended.", set()),
    ("The Fischer method is used; see Section 4.", set()),
    ("Dear all, the meeting moved to Monday.", set()),
    ("Rosa canina and Vera were grown side by side.", set()),
    ("Accession AB123456 was lost.", None),
    ("ftp://files.example.org/a@b is gone", set()),
    ("Coverage is 45 678 912 reads in total.", set()),
    ("Hello World examples are in the readme.", None),
]
#: What a sentence of the last part may yield without being counted is None: too close to call by rule.
LEAST = {"person": 0.7, "phone": 0.7, "id_number": 0.7, "address": 0.7, "email": 0.7}


def score(spark):
    docs = spark.read.parquet(f"{DATA.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    names = spark.read.parquet(f"{DATA}/name_parts.parquet").unionByName(spark.createDataFrame([(g, "given") for g in GIVEN], "name string, kind string"))
    gaz = P.gazetteer(names)
    model = P.train(P.find_candidates(docs, "doc_id", "text", gaz), gaz)
    found, true, both, wrong = ({k: 0 for k in P.KINDS} for _ in range(4))
    notes = []
    for text, want in CASES:
        if want is None:
            continue
        got = {(P.KINDS[k], x) for k, _, _, x in model.keep([(*c, text[c[1] : c[2]]) for c in P.candidates(text, gaz)])}
        for k, _ in want:
            true[k] += 1
        for k, x in got:
            found[k] += 1
            both[k] += (k, x) in want
            wrong[k] += (k, x) not in want
        if got != want:
            notes.append((text, sorted(want - got), sorted(got - want)))
    return {k: (both[k] / true[k], both[k] / max(1, found[k])) for k in P.KINDS}, notes


def test_held_out(spark):
    rates, notes = score(spark)
    for kind, (recall, precision) in rates.items():
        assert recall >= LEAST[kind] and precision >= LEAST[kind], (rates, notes)
