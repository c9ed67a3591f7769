import random
import re
import time

import cases
import pytest

from flowspark.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    odd = [int(d) for d in digits[-1::-2]]
    even = [sum(divmod(2 * int(d), 10)) for d in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def plain(text):
    """The contract's patterns one by one."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return [(start, end, kind) for start, _, end, kind in sorted(out)]


@pytest.mark.parametrize("letters", ["ab1.@-_+ 2", "19.0- 5+()a@", "0123456789 -", "a.@"])
def test_base_spans_equal_the_patterns(letters):
    rng = random.Random(letters)
    for _ in range(1500):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 70)))
        assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("run", ["a", "1", ".", "1.", "a@", "+1", "1 ", "@", "a."])
def test_long_runs_take_time_in_proportion(run):
    text = run * (1_000_000 // len(run)) + " x@y.z"
    start = time.perf_counter()
    assert ("email" in {k for _, _, k in pii.base_spans(text)}) is True
    assert time.perf_counter() - start < 5


def test_parts_of_thousands_of_digits_are_no_address(spark):
    rows = [(1, "1" * 5000 + ".1.2.3 and 9.9.9.9"), (2, "0" * 5000 + "7.1.2.3")]
    out = {r.doc_id: r.n_ip for r in pii.span_report(cases.frame(spark, rows)).collect()}
    assert out == {1: 1, 2: 1}
