"""Identity terms of the corpus' languages."""

from tessera.llm import toxicity


def test_no_term_is_of_two_kinds():
    terms = [t for kind in toxicity.IDENTITY_TERMS for t in kind]
    assert len(terms) == len(set(terms))


def test_swaps_in_every_language():
    pairs = [("the muslim man", "the jewish woman"), ("die jüdische Frau", "die hinduistische mann"), ("les Étrangers musulmans", "les immigrés juifs"), ("LOS JUDÍOS", "los hindúes"), ("El Árabe", "el africano")]
    for text, swapped in pairs:
        assert toxicity.swap_identities(text.encode()).decode() == swapped
