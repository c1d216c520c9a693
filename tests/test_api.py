import sitefold


def test_every_public_name_loads():
    assert all(callable(getattr(sitefold, name)) for name in sitefold.__all__)
    assert len(sitefold.__all__) >= 25
