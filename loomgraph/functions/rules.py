"""Rule tables as Columns: test paths and names, service calls, tracked files, languages, risks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.match import any_of

TEST_ENDS = [*(f"_test.{x}" for x in ("go", "py", "rs", "cpp", "lua")), "_spec.rb", *(f"Test.{x}" for x in ("java", "kt", "cs", "php")), "Spec.scala"]
TEST_PARTS = [*(f".{a}.{b}" for a in ("test", "spec") for b in ("ts", "js", "tsx")), "__tests__/", "/tests/", "/test/", "/spec/"]
TEST_STARTS = ["tests/", "test/", "spec/", "__tests__/"]


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_test_path(path: Column) -> Column:
    """The rule for indexing."""
    name = basename(path)
    return any_of([name.startswith("test_"), *(name.endswith(x) for x in TEST_ENDS), *(path.contains(x) for x in TEST_PARTS), *(path.startswith(x) for x in TEST_STARTS)])


def is_test_file(path: Column) -> Column:
    """The looser rule for queries."""
    return any_of([path.contains(x) for x in ("/test/", "/tests/", "/spec/", "test_", "_test.", ".test.")])


def is_test_function(name: Column) -> Column:
    whole = ["test", "it", "describe", "beforeAll", "afterAll", "beforeEach", "afterEach", "@testset", "@test"]
    return name.rlike(r"^(Test|Benchmark|Example)([A-Z].*)?$") | name.startswith("test_") | name.rlike(r"^test[A-Z]") | name.isin(whole)


def tested_path(path: Column) -> Column:
    """The production file that a test file belongs to by name, in the same directory; else null."""
    name = basename(path)
    head = F.substring(path, F.lit(1), F.char_length(path) - F.char_length(name))
    made = (
        F.when(name.endswith("_test.go"), F.regexp_replace(name, r"_test\.go$", ".go"))
        .when(name.startswith("test_") & name.endswith(".py"), F.regexp_replace(name, "^test_", ""))
        .when(name.contains(".test."), F.regexp_replace(name, r"\.test\.", "."))
        .when(name.contains(".spec."), F.regexp_replace(name, r"\.spec\.", "."))
    )
    return F.concat(head, made)


# Substrings of qualified names that tell services apart, and brokers by the first that matches.
ROUTE_REGISTRARS = """flask.route flask.add_url_rule app.route router.route express.Router express.route fastify.route
fastify.register koa.router hono.route hapi.route gin.Handle gin.GET gin.POST gin.PUT gin.DELETE gin.PATCH chi.Route
chi.Get chi.Post chi.Put chi.Delete gorilla/mux.HandleFunc gorilla/mux.Handle echo.GET echo.POST echo.PUT echo.DELETE
fiber.Get fiber.Post actix_web.route axum.route rocket.route starlette.route django.path django.url laravel.route
symfony.route""".split()
HTTP_CLIENTS = """requests.get requests.post requests.put requests.delete requests.patch requests.head requests.options
requests.request httpx.get httpx.post httpx.put httpx.delete httpx.patch httpx.request aiohttp.ClientSession
aiohttp.request urllib.request urllib3.request axios.get axios.post axios.put axios.delete axios.patch axios.request
axios.create superagent.get superagent.post node-fetch undici.fetch undici.request net/http.Get net/http.Post
net/http.Do resty.R resty.New HttpClient OkHttpClient okhttp3 RestTemplate WebClient reqwest.get reqwest.Client
hyper.Client HTTParty Faraday RestClient""".split()
BROKERS = """cloudtasks cloud.tasks pubsub PubSub pub_sub sqs SQS sns SNS eventbridge EventBridge lambda.invoke
Lambda.invoke step_functions StepFunctions kafka Kafka rabbitmq RabbitMQ amqp AMQP nats NATS redis.publish
Redis.publish redis.lpush redis.rpush celery.task celery.send_task celery.delay dramatiq.actor dramatiq.send huey.task
rq.Queue rq.enqueue bullmq BullMQ bull.Queue sidekiq Sidekiq resque Resque temporal.workflow temporal.activity
inngest.send inngest.create_function""".split()
BROKER_NAMES = """cloudtasks:cloud_tasks cloud.tasks:cloud_tasks pubsub:pubsub PubSub:pubsub pub_sub:pubsub sqs:sqs SQS:sqs
sns:sns SNS:sns eventbridge:eventbridge EventBridge:eventbridge kafka:kafka Kafka:kafka rabbitmq:rabbitmq
RabbitMQ:rabbitmq amqp:rabbitmq AMQP:rabbitmq nats:nats NATS:nats redis:redis celery:celery Celery:celery
dramatiq:dramatiq huey:huey rq.:rq bullmq:bullmq BullMQ:bullmq bull.Queue:bull sidekiq:sidekiq Sidekiq:sidekiq
resque:resque Resque:resque temporal:temporal inngest:inngest""".split()
METHODS = ["get", "post", "put", "delete", "patch", "head", "options"]


def service_kind(name: Column) -> Column:
    """route_registration before http_client before async_broker; null if none is named."""
    named = lambda table: any_of([name.contains(x) for x in table])
    return F.when(named(ROUTE_REGISTRARS), "route_registration").when(named(HTTP_CLIENTS), "http_client").when(named(BROKERS), "async_broker")


def http_method(name: Column) -> Column:
    """The method a call ends in, behind a dot and in one of three casings, in upper case; else null."""
    last = F.regexp_extract(name, r"\.([A-Za-z]+)$", 1)
    return F.when(last.isin([x for m in METHODS for x in (m, m.capitalize(), m.upper())]), F.upper(last))


def broker(name: Column) -> Column:
    """The broker of an asynchronous call; else null."""
    out = F.lit(None).cast("string")
    for pattern, found in reversed([x.split(":") for x in BROKER_NAMES]):
        out = F.when(name.contains(pattern), found).otherwise(out)
    return out


UNTRACKED_STARTS = [".git/", "node_modules/", "vendor/", "__pycache__/", ".cache/"]
UNTRACKED_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "poetry.lock", "composer.lock", "Gemfile.lock", "Pipfile.lock"]
UNTRACKED_ENDS = [".lock", ".sum", ".min.js", ".min.css", ".map", ".wasm", ".png", ".jpg", ".gif", ".ico", ".svg", ".pyc", ".o", ".so", ".dylib", ".class"]


def is_tracked(path: Column) -> Column:
    return ~any_of([*(path.startswith(x) for x in UNTRACKED_STARTS), basename(path).isin(UNTRACKED_NAMES), *(path.endswith(x) for x in UNTRACKED_ENDS)])


LANGUAGES = {
    "go": "go", "java": "java", "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx", "rs": "rust",
    "zig": "zig", "cs": "csharp", "ps1": "powershell", "gd": "gdscript", "yaml": "yaml", "yml": "yaml", "toml": "toml", "json": "json", "xml": "xml", "ini": "ini", "md": "markdown", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "rb": "ruby", "php": "php", "kt": "kotlin", "scala": "scala", "swift": "swift", "lua": "lua", "sh": "bash", "sql": "sql", "html": "html", "css": "css", "r": "r", "jl": "julia",
}


# Languages by whole file name, and words that tell apart the languages of files that end in .m.
FILE_NAMES = {"Dockerfile": "dockerfile", "Makefile": "makefile", "CMakeLists.txt": "cmake"}
OBJECTIVE_C = ["@interface", "@implementation", "@protocol", "@property", "#import", "@encode"]
MAGMA = ["theorem", "induction", "theorems", "import Mathlib", "classical", "lemma"]


def language(path: Column, overrides: dict[str, str] | None = None, content: Column | None = None) -> Column:
    """The language of a file by its name or extension, or null; overrides by extension come first, and what
    ends in .m is told by its first 4096 characters."""
    name = basename(path)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    by = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    out = F.coalesce(by(FILE_NAMES, name), by(LANGUAGES, ext))
    if content is not None:
        head = F.substring(content, 1, 4096)
        has = lambda words: any_of([head.contains(w) for w in words])
        out = F.when(ext == "m", F.when(has(OBJECTIVE_C), "objc").when(has(MAGMA), "magma").otherwise("matlab")).otherwise(out)
    return F.coalesce(by(overrides, ext), out) if overrides else out


def package(path: Column) -> Column:
    """The top directory, or a dot."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise(".")


def hop_risk(hop: Column) -> Column:
    return F.when(hop <= 1, "CRITICAL").when(hop == 2, "HIGH").when(hop == 3, "MEDIUM").otherwise("LOW")


def impact_risk(hop: Column) -> Column:
    return F.when(hop <= 1, "high").when(hop == 2, "medium").otherwise("low")


def grep_rank(label: Column) -> Column:
    return F.when(label.isin("Function", "Method", "Class", "Interface"), 0).when(label == "Variable", 1).when(label == "Module", 2).otherwise(3)


def bm25_boost(label: Column) -> Column:
    return F.when(label.isin("Function", "Method"), 10.0).when(label == "Route", 8.0).when(label.isin("Class", "Interface"), 5.0).otherwise(0.0)


def config_name(name: Column) -> Column:
    """A configuration key in one spelling: camel case and separators become dots, lower case."""
    split = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1.$2"), r"[-_./: ]+", ".")
    return F.lower(F.regexp_replace(split, r"^\.+|\.+$", ""))


def is_specific_config(normal: Column) -> Column:
    """At least two parts, all of them of three characters or more."""
    parts = F.split(normal, r"\.")
    return (F.size(parts) >= 2) & F.forall(parts, lambda p: F.char_length(p) >= 3)
