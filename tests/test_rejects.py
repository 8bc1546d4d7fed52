"""Record parsing against a character-by-character reading."""

import random
import re

import pyarrow as pa
import pytest

from loomspan.operators.rejects import CALL_FIELDS, Field, file_records, load_files, load_records, parse_batch

TOP = 9223372036854775807


def split_record(raw):
    """Fields of a record, or None if its quoting is broken."""
    out, i, n = [], 0, len(raw)
    while True:
        if i < n and raw[i] == '"':
            i += 1
            field = ""
            while True:
                if i >= n:
                    return None
                if raw[i] == '"':
                    if i + 1 < n and raw[i + 1] == '"':
                        field += '"'
                        i += 2
                        continue
                    i += 1
                    break
                field += raw[i]
                i += 1
            if i < n and raw[i] != ",":
                return None
        else:
            j = raw.find(",", i)
            j = n if j < 0 else j
            field = raw[i:j]
            if '"' in field:
                return None
            i = j
        out.append(field)
        if i >= n:
            return out
        i += 1


def brute(raw):
    """(reason, fields) of one record; None for a comment."""
    if raw is not None and raw.startswith("#"):
        return None
    if raw is None or raw == "":
        return "column_count", None
    f = split_record(raw)
    if f is None:
        return "quoting", None
    if len(f) != 8:
        return "column_count", None
    t = [x.strip(" ") for x in f]
    if not re.fullmatch("[0-9]+", t[2]) or not 1 <= int(t[2]) <= TOP:
        return "bad_pos", None
    if not re.fullmatch("[0-9]+", t[3]) or not int(t[2]) <= int(t[3]) <= TOP:
        return "bad_end", None
    if t[4] not in ("", ".", "NA") and not (re.fullmatch("-?[0-9]+", t[4]) and -TOP - 1 <= int(t[4]) <= TOP):
        return "bad_len", None
    if t[5] not in ("P", "S", "I", "i"):
        return "bad_tp", None
    return None, (f[0], f[1], int(t[2]), int(t[3]), None if t[4] in ("", ".", "NA") else int(t[4]), t[5], f[6], f[7])


CASES = [
    None, "", "#", '# "x', "a,b,1,2,3,P,s,n", 'a,b,1,2,3,P,s,"x,y"', 'a,b,1,2,3,P,s,"x ""q"" y"', 'a,b,1,2,3,P,s,"line\nbreak"', 'a,b,"1","2","3","P",s,""', 'a,b, 1 , 2,3 ,P ,s,', "a,b,001,0002,-5,i,s,n",
    "a,b,0,2,3,P,s,n", "a,b,5,4,3,P,s,n", "a,b,x,4,3,P,s,n", "a,b,1,NA,3,P,s,n", "a,b,1,2,NA,S,s,n", "a,b,1,2,.,S,s,n", "a,b,1,2,,S,s,n", "a,b,1,2,--3,S,s,n", "a,b,1,2,-,S,s,n", "a,b,1,2,3.0,S,s,n", "a,b,1,2,3,p,s,n", "a,b,1,2,3,,s,n",
    "a,b,1,2,3,P,s", "a,b,1,2,3,P,s,n,m", 'a,b,1,2,3,P,s,"open', 'a,b,1,2,3,P,s,x"y"', 'a,b,1,2,3,P,s,"x"y', 'a,b,1,2,3,P,s, "x"', 'a,b,1,2,3,P,s,"x" ', 'a,b,1,2,3,P,s,""""', 'a,b,1,2,3,P,s,"""', 'a,b,1,2,3,P,s,\\"x', '"', '""', '"""",b,1,2,3,P,s,n',
    f"a,b,{TOP},{TOP},{-TOP - 1},P,s,n", f"a,b,{TOP + 1},{TOP},3,P,s,n", f"a,b,1,{TOP + 1},3,P,s,n", f"a,b,1,2,{-TOP - 2},P,s,n", f"a,b,{'0' * 40}7,8,3,P,s,n", "a,b,99999999999999999999999,2,3,P,s,n", "a,b,1\xa0,2,3,P,s,n", "a,b,١,2,3,P,s,n", "é,b,1,2,3,P,s,\N{GREEK SMALL LETTER ALPHA}", "a,b,1,2,3,P,s,n\r", ",,1,2,3,P,,", " #,b,1,2,3,P,s,n", "a,b,\t1,2,3,P,s,n",
]


def check(records):
    got = parse_batch(pa.array(records, pa.string()), CALL_FIELDS)
    for i, raw in enumerate(records):
        want = brute(raw)
        assert bool(got["keep"][i]) == (want is not None), raw
        if want is None:
            continue
        assert got["reason"][i] == want[0], raw
        if want[0] is None:
            assert tuple(c[i].as_py() for c in got["columns"].values()) == want[1], raw
        else:
            assert all(c[i].as_py() is None for c in got["columns"].values())


def test_cases():
    check(CASES)
    for c in CASES:
        check([c])


def test_random_records():
    rng = random.Random(7)
    parts = ["a", "1", "22", '"', '""', ",", ",", ",", " ", "-3", "P", "S", ".", "NA", "\n", "0", "é"]
    check(["".join(rng.choice(parts) for _ in range(rng.randint(0, 24))) for _ in range(4000)])
    good = 'a,b,1,2,3,P,s,"n,""m"""'
    check([good[:i] + rng.choice(parts) + good[i:] for i in range(len(good)) for _ in range(4)] + [good[:i] + good[i + 1 :] for i in range(len(good))])


def test_sliced_and_empty_arrays():
    whole = pa.array(["zzz", *CASES[4:9]], pa.string())
    got = parse_batch(whole.slice(1, 3), CALL_FIELDS)
    assert list(got["reason"]) == [brute(c)[0] for c in CASES[4:7]]
    assert len(parse_batch(pa.array([], pa.string()), CALL_FIELDS)["reason"]) == 0


def test_frame_keeps_columns(spark):
    df = spark.createDataFrame([(1, "f", "a,b,1,2,3,P,s,n", "clash"), (2, None, "bad", None), (3, "f", "#c", None)], "line_id bigint, file_name string, raw string, pos string")
    out = load_records(df, "raw", CALL_FIELDS)
    assert out.columns == ["line_id", "file_name", "id", "chrom", "pos", "end", "len", "tp", "sample", "note", "reason"]
    rows = {r["line_id"]: r for r in out.collect()}
    assert set(rows) == {1, 2} and rows[1]["pos"] == 1 and rows[1]["reason"] is None and rows[2]["reason"] == "column_count"


def test_empty_frame_and_one_field(spark):
    assert load_records(spark.createDataFrame([], "raw string"), "raw", CALL_FIELDS).count() == 0
    one = load_records(spark.createDataFrame([("7",), ("x",)], "raw string"), "raw", [Field("n", "int")]).collect()
    assert sorted((r["n"], r["reason"]) for r in one if r["reason"] is None) == [(7, None)] and len(one) == 2


@pytest.mark.parametrize("size", [100_000])
def test_very_long_record(size):
    check(["a,b,1,2,3,P,s," + "x" * size, 'a,b,1,2,3,P,s,"' + ("," * size) + '"', "9" * size])


GOOD = ['a,b,1,2,3,P,s,"x\ny"', 'a,b,1,2,3,P,s,"x ""q"" y"', "a,b,1,2,3,P,s,n", 'a,b,1,2,3,P,s,"\n\nlong\n' + "z" * 90 + '\n"', 'a,"b,c",1,2,3,P,s,""', '"a\n""b""\n",b,1,2,3,P,s,""""', 'a,b,1,2,3,P,s,"é\n,"']
BAD = ["", "a,b", "a,b,0,2,3,P,s,n", 'a,b,1,2,3,P,s,5" pipe', 'a,b,1,2,3,P,s,"open', 'a,"open,1,2,3,P,s,n', "# comment"]


@pytest.mark.parametrize("split", [64, 150, 1000, 1 << 20])
def test_records_of_files(spark, tmp_path, split):
    rng = random.Random(split)
    want = []
    for f in range(3):
        records = [rng.choice(BAD if rng.random() < 0.3 else GOOD) for _ in range(120)]
        # a quote at a line's end may close what an open one began: such a text is no error
        records = [x for r in records for x in ([r, GOOD[1]] if "open" in r else [r])]
        want += [(f"f{f}.csv", r) for r in records]
        (tmp_path / f"f{f}.csv").write_bytes(("\r\n" if f == 1 else "\n").join(r.replace("\n", "\r\n") if f == 1 else r for r in records).encode() + b"\n" * (f == 2))
    (tmp_path / "empty.csv").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        got = [(r["file_name"].rsplit("/", 1)[1], r["raw"].replace("\r\n", "\n")) for r in file_records(spark, str(tmp_path)).collect()]
        rows = load_files(spark, str(tmp_path), CALL_FIELDS).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == sorted(want)
    assert sum(r["reason"] is None for r in rows) == sum(r in GOOD for _, r in want)
    assert sorted(r["raw"].replace("\r\n", "\n") for r in rows if r["reason"]) == sorted(r for _, r in want if r in BAD and r[:1] != "#")


def test_numbers_and_dates():
    fields = [Field("x", "number", missing=("NA",)), Field("d", "date", missing=("",))]
    rows = ["1.5,2024-02-29", "-.5e3,2023-02-29", "+7., 2000-02-29 ", "NA,", "1e,2024-01-01", "inf,2024-01-01", ".,2024-01-01", "3,2024-13-01", "3,1900-02-29", "3,2024-04-31", "3,2024-4-1"]
    got = parse_batch(pa.array(rows), fields)
    assert list(got["reason"]) == [None, "bad_d", None, None, "bad_x", "bad_x", "bad_x", "bad_d", "bad_d", "bad_d", "bad_d"]
    assert got["columns"]["x"].to_pylist()[:4] == [1.5, None, 7.0, None]
    assert [str(x) for x in got["columns"]["d"].to_pylist()[:4]] == ["2024-02-29", "None", "2000-02-29", "None"]
