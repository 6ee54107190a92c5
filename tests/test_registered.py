import pytest

from folioscan.plans import registry


class Called(Exception):
    pass


def test_search_latent_fits_as_the_operator_does(monkeypatch):
    def fit(index, k=128, fit_rows=100_000):
        raise Called(k, fit_rows)

    monkeypatch.setattr(registry, "index", lambda spark, d: None)
    monkeypatch.setattr(registry, "titles", lambda ix: None)
    monkeypatch.setattr(registry.L, "fit_svd", fit)
    with pytest.raises(Called) as called:
        registry.QUERIES["search_latent"](None, "")
    assert called.value.args == (128, 100_000)
