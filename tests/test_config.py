from millrace.config import lint, load, run_tests

GOOD = """
input: {generate: {count: 3, mapping: 'root.n = this.id'}}
pipeline:
  processors:
    - mapping: 'root.n = this.n + ${STEP:1}'
    - switch:
        - check: this.n == 2
          processors: [{mapping: 'root = deleted()'}]
output: {drop: {}}
tests:
  - name: numbers grow and two goes
    input_batch: [{content: '{"n":1}'}, {content: '{"n":5}', metadata: {k: v}}]
    output_batches:
      - - {json_equals: {n: 6}, metadata_equals: {k: v}, bloblang: 'root = this.n == 6'}
  - name: mocks
    mocks: {/pipeline/processors/0: {mapping: 'root.n = 9'}}
    input_batch: [{content: '{}'}]
    output_batches: [[{content_equals: '{"n":9}'}]]
"""


def test_good_documents_pass():
    assert lint(GOOD) == []
    assert [o.problems for o in run_tests(GOOD)] == [[], []]


def test_environment_and_templates():
    assert load("a: ${X:7}")["a"] == 7
    assert load("a: ${X:7}", {"X": "8"})["a"] == 8
    doc = load("templates: [{name: shout, fields: [{name: f, default: s}], mapping: 'root.mapping = \"root = this.\" + this.f + \".uppercase()\"'}]\npipeline: {processors: [{shout: {f: t}}]}")
    assert doc["pipeline"]["processors"] == [{"mapping": "root = this.t.uppercase()"}]


def test_what_is_not_supported_is_named():
    bad = """
inputs: {}
logger: {level: INFO}
input: {generate: {batch_size: 3, interval: '@every 5s'}}
pipeline: {threads: 4, processors: [{unheard: {}}, {archive: {format: tar}}, {mapping: 'root = this.nope()'}, {workflow: {branches: {a: {}}}}, {cpp: 'x'}, {dedupe: {cache: none, key: a}}]}
output: {http_client: {url: 'https://example.org'}}
cache_resources: []
buffer: {sqlite: {}}
"""
    found = "\n".join(lint(bad))
    for word in ("inputs", "logger", "batch_size", "cron", "threads", "unheard", "tar", "nope", "order", "cpp", "none", "https", "sqlite"):
        assert word in found, word
