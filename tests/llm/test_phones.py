"""Phone numbers by their format, in the number plan or not."""

import pytest

from cropledger.llm import pii


@pytest.mark.parametrize("value", ["+1 (017) 555-7713", "+1 (132) 555-1352", "(171) 555-2028", "211-555-0100", "+1 (269) 555-3296"])
def test_every_well_formed_number_is_replaced_and_keeps_its_class(value):
    p = pii.Pseudonyms(b"k")
    text, counts, spans = p.replace(f"call {value}.")
    new = text[5:-1]
    assert new != value and counts[pii.KINDS.index("phone")] == 1 and spans == [5, 5 + len(value)]
    assert [c if not c.isdigit() else "0" for c in new] == [c if not c.isdigit() else "0" for c in value]
    own = lambda v: "".join(c for c in v if c.isdigit())[-10:]
    assert pii._phone_ok(own(new)) == pii._phone_ok(own(value))


def test_numbers_outside_the_plan_have_different_pseudonyms():
    p = pii.Pseudonyms(b"k")
    assert len({p.of("phone", f"017-555-{n:04d}") for n in range(500)}) == 500
