from tests.conftest import con, spark  # noqa: F401
