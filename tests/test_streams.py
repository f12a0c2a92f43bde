import pytest

from millrace.operators.batches import ConfigError, Resources
from millrace.sources import outputs
from millrace.streaming import runner


@pytest.mark.parametrize("chain", [[{"dedupe": {"cache": "c", "key": "k"}}], [{"switch": [{"processors": [{"resource": "once"}]}]}]])
def test_dedupe_in_the_chain_of_a_stream_is_refused(spark, tmp_path, chain):
    resources = Resources({"once": {"dedupe": {"cache": "c", "key": "k"}}}, {"c": {"memory": {}}})
    (tmp_path / "in").mkdir()
    with pytest.raises(ConfigError, match="dedupe"):
        runner.start(runner.lines(spark, str(tmp_path / "in")), runner.from_lines, chain, outputs.drop, str(tmp_path / "at"), resources)
