"""What the graph says beyond its edges: the class projection, layers, links to tests, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import cut, cut_measured
from graphloom.functions.names import annotation_names, annotations, member, owner, package, short_class, top_class
from graphloom.operators import graph as G
from graphloom.operators.walk import components

#: What an edge between two classes weighs.
WEIGHTS = {"CALLS": 1.0, "DISPATCHES_TO": 1.0, "INJECTS": 2.0, "EXTENDS": 3.0, "IMPLEMENTS": 3.0, "USES_TYPE": 0.5, "READS_FIELD": 1.0, "WRITES_FIELD": 1.0}
#: Endings of class names by layer, in the order they are tried.
SUFFIXES = {
    "controller": ("Controller", "Resource", "Endpoint", "RestApi"),
    "repository": ("Repository", "Dao", "DAO", "Store"),
    "client": ("Client", "Gateway", "Adapter", "Feign"),
    "config": ("Config", "Configuration", "Properties", "Settings"),
    "util": ("Util", "Utils", "Helper", "Helpers", "Support"),
    "model": ("Dto", "DTO", "Entity", "Request", "Response", "Event", "Model", "Record", "Payload", "Vo", "VO"),
    "service": ("Service", "Manager", "Handler", "Processor", "UseCase", "Facade", "Listener", "Consumer", "Producer", "Job", "Scheduler"),
}
#: Annotations of classes by layer, in the order they are tried, before any ending.
ANNOTATED = {
    "repository": ("org.springframework.stereotype.Repository",),
    "controller": (
        "org.springframework.stereotype.Controller", "org.springframework.web.bind.annotation.RestController", "org.springframework.web.bind.annotation.ControllerAdvice",
        "org.springframework.web.bind.annotation.RestControllerAdvice", "jakarta.ws.rs.Path", "javax.ws.rs.Path"),
    "client": ("org.springframework.cloud.openfeign.FeignClient",),
    "config": (
        "org.springframework.context.annotation.Configuration", "org.springframework.boot.context.properties.ConfigurationProperties", "org.springframework.boot.autoconfigure.SpringBootApplication"),
    "model": (
        "jakarta.persistence.Entity", "javax.persistence.Entity", "jakarta.persistence.Embeddable", "org.springframework.data.mongodb.core.mapping.Document", "org.springframework.data.redis.core.RedisHash"),
    "service": ("org.springframework.stereotype.Service",),
}
#: The annotation that makes a service of a class whose name tells nothing, and supertypes that make a repository.
COMPONENT, DATA_TYPES = "org.springframework.stereotype.Component", ("org.springframework.data.", "Repository")
#: The layers that a layer must not depend on.
FORBIDDEN = {
    "controller": ("controller",), "service": ("controller",), "repository": ("controller", "service"), "client": ("controller", "service", "repository"),
    "model": ("controller", "service", "repository", "client"), "util": ("controller", "service", "repository", "client"),
}
#: Endings of the names of tests, and methods of data classes.
TEST_SUFFIXES = ("Test", "Tests", "IT", "Spec", "TestCase")
OBJECT_METHODS = ("toString", "equals", "hashCode", "builder", "build", "of", "compareTo")
#: Methods that contracts outside the graph call.
CONTRACT_METHODS = ("toString", "equals", "hashCode", "compareTo", "run", "call", "apply", "accept", "get", "test", "close", "iterator", "main")
#: Annotations of methods that a framework enters, and of classes that it drives by itself.
ENTRY_ANNOTATIONS = tuple(
    "Scheduled Schedules PostConstruct PreDestroy EventListener TransactionalEventListener ApplicationModuleListener KafkaListener KafkaHandler RabbitListener RabbitHandler JmsListener SqsListener "
    "StreamListener ServiceActivator Bean ExceptionHandler InitBinder ModelAttribute MessageMapping SubscribeMapping MessageExceptionHandler Before After Around AfterReturning AfterThrowing Pointcut "
    "Test ParameterizedTest RepeatedTest TestFactory BeforeEach AfterEach BeforeAll AfterAll DynamicPropertySource JsonCreator JsonValue JsonAnySetter JsonAnyGetter PrePersist PreUpdate PostLoad "
    "PreRemove PostPersist PostUpdate PostRemove RequestMapping GetMapping PostMapping PutMapping DeleteMapping PatchMapping QueryMapping MutationMapping SchemaMapping".split()
)
LIVE_CLASS_ANNOTATIONS = ("Configuration", "AutoConfiguration", "SpringBootApplication", "ControllerAdvice", "RestControllerAdvice", "Aspect", "WebFilter", "ServerEndpoint")
#: Steps from dead classes to what only they refer to that one round takes before it is written.
STEPS_PER_ROUND = 4
#: Lines of a file that one key of the joins on lines stands for.
LINES_PER_BLOCK = 64
#: Edges that make their target used.
REFERENCES = ("USES_TYPE", "EXTENDS", "IMPLEMENTS", "INJECTS", "MAPS_TO_TABLE", "CALLS", "DISPATCHES_TO", "READS_FIELD", "WRITES_FIELD")


def classes(g: G.Graph) -> DataFrame:
    """The types that count: no tests, not external."""
    return g.nodes.where(G.is_code() & (F.col("origin") != "EXTERNAL")).where(~G.is_test())


def class_projection(g: G.Graph) -> DataFrame:
    """src, dst, weight: what classes depend on each other by, over the edges of their members. Sums are made before any join, on pairs of owners."""
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    w = F.try_element_at(weight, F.col("kind")) * F.when(F.col("kind") == "DISPATCHES_TO", F.col("confidence")).otherwise(1.0)
    pairs = g.edges.where(F.col("kind").isin(*WEIGHTS)).groupBy(owner("src").alias("src"), owner("dst").alias("dst")).agg(F.sum(w).alias("weight")).where("src <> dst")
    known = classes(g).select("id")
    return pairs.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")


def in_degrees(projection: DataFrame) -> DataFrame:
    """id, n: on how many classes' way a class is."""
    return projection.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))


def layers(g: G.Graph, projection: DataFrame) -> DataFrame:
    """id, layer of each class, null where nothing tells: by its annotations or a supertype of a data framework, then by the ending of its name; a bare component is
    a service; else records and enums are models, what talks to repositories or clients is a service, and what only holds data a model. The second pass
    looks at the first one's layers only."""
    name = short_class("id")
    begin, end = DATA_TYPES
    data = g.edges.where("kind in ('EXTENDS', 'IMPLEMENTS')").where(F.startswith("dst", F.lit(begin)) & F.endswith("dst", F.lit(end))).select(F.col("src").alias("_data")).distinct()
    notes = F.map_keys(annotations("attrs"))
    noted = lambda names: F.coalesce(F.arrays_overlap(notes, F.array(*(F.lit(x) for x in names))), F.lit(False))
    told = F.when(F.col("_data").isNotNull(), "repository")
    for layer, names in ANNOTATED.items():
        told = told.when(noted(names), layer)
    for layer, ends in SUFFIXES.items():
        hit = F.lit(False)
        for e in ends:
            hit = hit | (F.endswith(name, F.lit(e)) & (F.length(name) > len(e)))
        told = told.when(hit, layer)
    told = told.when(noted((COMPONENT,)), "service")
    first = cut(classes(g).select("id", "kind", "attrs").join(data, F.col("id") == F.col("_data"), "left").select("id", "kind", told.alias("named")))
    talks = projection.join(first.where("named in ('repository', 'client')").select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("_talks")).distinct()
    depends = projection.select(F.col("src").alias("_depends")).distinct()
    method = F.substring_index(member("dst"), "(", 1)
    working = g.edges.where("kind = 'CONTAINS' and contains(dst, '(')").where(~(method.rlike("^(get|set|is|<)") | method.isin(*OBJECT_METHODS))).select(F.col("src").alias("_works")).distinct()
    both = first.join(talks, F.col("id") == F.col("_talks"), "left").join(depends, F.col("id") == F.col("_depends"), "left").join(working, F.col("id") == F.col("_works"), "left")
    rest = F.when(F.col("kind").isin("RECORD", "ENUM"), "model").when(F.col("_talks").isNotNull(), "service").when(F.col("_depends").isNull() & F.col("_works").isNull(), "model")
    return both.select("id", F.coalesce("named", rest).alias("layer"))


def layer_violations(projection: DataFrame, layer: DataFrame) -> DataFrame:
    """src, dst, src_layer, dst_layer of dependencies that a layer must not have."""
    bad = [(a, b) for a, bs in FORBIDDEN.items() for b in bs]
    with_src = projection.join(layer.select(F.col("id").alias("src"), F.col("layer").alias("src_layer")), "src")
    with_both = with_src.join(layer.select(F.col("id").alias("dst"), F.col("layer").alias("dst_layer")), "dst")
    pair = F.concat_ws(">", "src_layer", "dst_layer")
    return with_both.where("src_layer is not null and dst_layer is not null").where(pair.isin(*(f"{a}>{b}" for a, b in bad))).select("src", "dst", "src_layer", "dst_layer")


def test_links(g: G.Graph) -> DataFrame:
    """src, dst, resolution: tests and the classes they exercise, exact by reference, else heuristic by name in the same package."""
    tests = cut(g.nodes.where(G.is_code()).where(G.is_test()).select("id"))
    known = cut(classes(g).select("id"))
    held = g.edges.where("kind = 'CONTAINS'").join(tests.withColumnRenamed("id", "src"), "src").select(F.col("src").alias("test"), F.col("dst").alias("from"))
    ends = tests.select(F.col("id").alias("test"), F.col("id").alias("from")).union(held)
    used = g.edges.where("kind <> 'CONTAINS'").select(F.col("src").alias("from"), owner("dst").alias("dst"))
    exact = ends.join(used, "from").where("test <> dst").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("test").alias("src"), "dst").distinct()
    name = F.substring_index("id", ".", -1)
    subject = F.coalesce(*(F.when(F.endswith(name, F.lit(s)) & (F.length(name) > len(s)), F.substr("id", F.lit(1), F.length("id") - len(s))) for s in TEST_SUFFIXES))
    named = tests.select(F.col("id").alias("src"), subject.alias("dst")).join(known.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst").join(exact, ["src", "dst"], "left_anti")
    return exact.withColumn("resolution", F.lit("EXACT")).unionByName(named.withColumn("resolution", F.lit("HEURISTIC")))


def cyclic_packages(g: G.Graph, projection: DataFrame) -> DataFrame:
    """id, component: packages of the project that depend on each other in a ring, named by the smallest of them."""
    own = classes(g).where("origin = 'REPO'").select("id")
    links = projection.join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
    found = components(links.select(package("src").alias("src"), package("dst").alias("dst")).where("src <> dst"))
    return found.withColumn("n", F.count("*").over(Window.partitionBy("component"))).where("n > 1").select("id", "component")


def _named_supertypes(signature: Column) -> Column:
    """How many types a class signature names above it."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(signature, F.lit("")), "<[^<>]*>", ""), "<[^<>]*>", ""), "<[^<>]*>", "")
    tail = F.regexp_extract(plain, r"(\s(?:extends|implements)\s.*)$", 1)
    return F.size(F.filter(F.split(F.regexp_replace(tail, r"\s(extends|implements)\s", ","), ","), lambda x: F.trim(x) != ""))


def generated_members(g: G.Graph) -> DataFrame:
    """id of the members that a compiler plugin made: marked as such, or a method of one line that stands above the first written member of its class or on the
    lines of a field.

    Fields meet methods by class and block of lines, so a class with very many members is no one group."""
    block = lambda c: F.floor(c / LINES_PER_BLOCK)
    types = g.nodes.where(G.is_code()).select(F.col("id").alias("src"))
    inside = g.edges.where("kind = 'CONTAINS'").select("src", "dst").join(types, "src", "left_semi")
    known = g.nodes.where("kind in ('METHOD', 'CONSTRUCTOR', 'FIELD') and start_line is not null").select(F.col("id").alias("dst"), "kind", F.col("start_line").alias("lo"), F.coalesce("end_line", "start_line").alias("hi"), "end_line")
    held = cut(inside.join(known, "dst"))
    written = held.where("kind = 'FIELD' or coalesce(end_line, 0) > lo").groupBy(F.col("src").alias("_src")).agg(F.min("lo").alias("first"))
    lines = held.where("kind <> 'FIELD' and end_line = lo").select("src", "dst", F.col("lo").alias("line"))
    above = lines.join(written, F.col("src") == F.col("_src"), "left").where("first is null or line < first").select("dst")
    spans = held.where("kind = 'FIELD' and hi >= lo").select(F.col("src").alias("_src"), "lo", "hi", F.explode(F.sequence(block(F.col("lo")), block(F.col("hi")))).alias("_block"))
    on = lines.join(spans, (F.col("src") == F.col("_src")) & (block(F.col("line")) == F.col("_block"))).where("line between lo and hi").select("dst")
    marked = g.nodes.where(F.contains(F.coalesce(G.attr("annotations"), F.lit("")), F.lit("lombok.Generated"))).select(F.col("id").alias("dst"))
    return above.union(on).union(marked).distinct().select(F.col("dst").alias("id"))


def live_references(g: G.Graph, generated: DataFrame) -> DataFrame:
    """src, dst, kind, test: the edges of REFERENCES that written code has, where an injected bean stands for its type; test tells those of tests apart."""
    beans = g.nodes.where("kind = 'BEAN'").select(F.col("id").alias("_b"), G.attr("type").alias("_type"))
    tests = g.nodes.where(G.is_test()).select(F.col("id").alias("_t"))
    edges = g.edges.where(F.col("kind").isin(*REFERENCES)).select("src", "dst", "kind").join(generated.select(F.col("id").alias("src")), "src", "left_anti")
    injected = edges.where("kind = 'INJECTS'").join(beans, F.col("dst") == F.col("_b"), "left").select("src", F.coalesce("_type", "dst").alias("dst"), "kind")
    whole = edges.where("kind <> 'INJECTS'").unionByName(injected)
    told = whole.join(tests, F.col("src") == F.col("_t"), "left").withColumn("_own", F.col("_t").isNotNull()).drop("_t")
    return told.join(tests, top_class("src") == F.col("_t"), "left").select("src", "dst", "kind", (F.col("_own") | F.col("_t").isNotNull()).alias("test"))


def _entered(g: G.Graph) -> DataFrame:
    """id of the members that a framework enters: main, scheduled, annotated so, or with a route, messages or a bean."""
    noted = g.nodes.where(F.arrays_overlap(annotation_names("attrs"), F.array(*(F.lit(x) for x in ENTRY_ANNOTATIONS)))).select("id")
    mains = g.nodes.where(F.startswith(member("id"), F.lit("main("))).select("id")
    jobs = g.nodes.where("kind = 'SCHEDULED_JOB'").select(F.col("fqn").alias("id"))
    wired = g.edges.where("kind in ('HANDLES_ROUTE', 'CONSUMES_FROM', 'PROVIDES_BEAN')").select(F.col("src").alias("id"))
    return noted.union(mains).union(jobs).union(wired).distinct()


def _contracts(g: G.Graph) -> DataFrame:
    """id, contract of each class: whether it has a supertype that the graph can't see into."""
    supers = g.edges.where("kind in ('EXTENDS', 'IMPLEMENTS')").join(g.nodes.select(F.col("id").alias("_n"), "origin"), F.col("dst") == F.col("_n"), "left")
    above = supers.groupBy(F.col("src").alias("_s")).agg(F.count("*").alias("n_above"), F.max((F.col("origin") == "EXTERNAL").cast("int")).alias("outside"))
    contract = (_named_supertypes(F.col("signature")) > F.coalesce("n_above", F.lit(0))) | (F.coalesce("outside", F.lit(0)) > 0)
    return classes(g).where("origin = 'REPO'").join(above, F.col("id") == F.col("_s"), "left").select("id", "kind", "attrs", contract.alias("contract"))


def dead_classes(g: G.Graph, refs: DataFrame | None = None) -> DataFrame:
    """id, via: classes of the project that nothing live refers to: no referrer, or only dead ones, of which via is the smallest id.

    A reference is one of live_references between different outermost classes; tests and generated code don't count. Not judged are annotations, nested
    classes, classes that a framework drives, classes with a supertype outside the graph unless a bean interface, and those with a member that a framework
    enters. Each round adds what only dead classes refer to, until nothing is added; rings of live-looking classes stay alive."""
    refs = cut(live_references(g, generated_members(g))) if refs is None else refs
    used = cut(refs.where("not test").select(top_class("dst").alias("cls"), top_class("src").alias("by")).where("cls <> by").distinct())
    beans = g.edges.where("kind = 'PROVIDES_BEAN'").select(F.col("src").alias("_b")).distinct()
    entered = g.edges.where("kind = 'CONTAINS'").join(_entered(g).select(F.col("id").alias("_m")), F.col("dst") == F.col("_m"), "left_semi").select(F.col("src").alias("_e")).distinct()
    driven = F.exists(annotation_names("attrs"), lambda a: a.isin(*LIVE_CLASS_ANNOTATIONS) | F.startswith(a, F.lit("Enable")))
    own = _contracts(g).where("kind <> 'ANNOTATION' and not contains(id, '$')").where(~driven)
    facts = own.join(beans, F.col("id") == F.col("_b"), "left").join(entered, F.col("id") == F.col("_e"), "left_anti")
    judged = cut(facts.where(((F.col("kind") == "INTERFACE") & F.col("_b").isNotNull()) | ~F.col("contract")).select("id"))
    asked = cut(used.join(judged.select(F.col("id").alias("cls")), "cls", "left_semi"))
    state, n = judged.withColumn("dead", F.lit(False)), -1
    while True:
        after = state
        for _ in range(STEPS_PER_ROUND):
            live = asked.join(after.where("dead").select(F.col("id").alias("by")), "by", "left_anti").select(F.col("cls").alias("_live")).distinct()
            after = judged.join(live, F.col("id") == F.col("_live"), "left").select("id", F.col("_live").isNull().alias("dead"))
        state, seen = cut_measured(after, state, n=F.count_if(F.col("dead")))
        if seen["n"] == n:
            break
        n = seen["n"]
    dead = state.where("dead").select("id")
    via = used.groupBy(F.col("cls").alias("id")).agg(F.min("by").alias("via"))
    return dead.join(via, "id", "left")


def dead_members(g: G.Graph, refs: DataFrame | None = None, dead: DataFrame | None = None) -> DataFrame:
    """id, what (method, field), severity, tested, implements: methods of the project that no live code calls, nor what they implement, and constants that nothing reads.

    tested: whether tests call it. implements: the smallest id that it overrides. Members of dead classes, of interfaces and of annotations are not judged, nor are
    contracts of frameworks, accessors of a field of the class, what an enum or a record has by itself, overridden and abstract methods, loggers and
    generated members."""
    made = cut(generated_members(g))
    refs = cut(live_references(g, made)) if refs is None else refs
    dead = cut(dead_classes(g, refs)) if dead is None else dead
    own = _contracts(g).where("kind not in ('INTERFACE', 'ANNOTATION')").select(F.col("id").alias("cls"), F.col("kind").alias("of"), "contract")
    own = own.join(dead.select(F.col("id").alias("_d")), top_class("cls") == F.col("_d"), "left_anti")
    nodes = g.nodes.where("kind in ('METHOD', 'FIELD')").select("id", "kind", F.coalesce("signature", F.lit("")).alias("sig"))
    inside = g.edges.where("kind = 'CONTAINS'").select(F.col("src").alias("cls"), F.col("dst").alias("id"))
    held = cut(inside.join(own, "cls").join(nodes, "id").join(made, "id", "left_anti"))
    said = lambda *words: [F.contains("sig", F.lit(w)) for w in words]
    ids = lambda df, c: df.select(F.col(c).alias("id")).distinct()
    name = member("id")
    kind = F.when(F.contains("sig", F.lit(": ")), F.substr("sig", F.locate(": ", F.col("sig")) + 2)).otherwise("")
    logger = F.endswith(kind, F.lit("Logger")) | F.endswith(kind, F.lit(".Log")) | F.lower(name).isin("log", "logger")
    static, final = said("static", "final")
    read = ids(refs.where("kind = 'READS_FIELD' and not test"), "dst")
    fields = held.where("kind = 'FIELD'").where(static & final & (name != "serialVersionUID") & ~logger).join(read, "id", "left_anti")
    calls = refs.where("kind in ('CALLS', 'DISPATCHES_TO')")
    called, tested = ids(calls.where("not test"), "dst"), ids(calls.where("test"), "dst")
    method = F.substring_index(name, "(", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(method, "^get", ""), "^set", ""), "^is", "")
    prop = F.concat(F.lower(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)))
    public, protected, abstract = said("public", "protected", "abstract")
    asked = held.where("kind = 'METHOD'").select("*", method.alias("name"), prop.alias("prop"), (public | protected).alias("visible")).where(
        ~F.col("name").isin(*CONTRACT_METHODS) & ~F.startswith("name", F.lit("lambda$")) & ~F.startswith("name", F.lit("<")) & ~abstract & ~(F.col("visible") & F.col("contract"))
        & ~((F.col("of") == "ENUM") & F.col("name").isin("values", "valueOf")) & ~((F.col("of") == "RECORD") & F.endswith("id", F.lit("()"))))
    has = F.when((F.col("name") != F.col("prop")) & (F.col("prop") != ""), F.concat("cls", F.lit("#"), "prop"))
    members = ids(g.edges.where("kind = 'CONTAINS'").where(owner("dst") == F.col("src")), "dst").withColumnRenamed("id", "_p")
    over = g.edges.where("kind = 'OVERRIDES'").select("src", "dst")
    known = g.nodes.where("origin = 'REPO'").select(F.col("id").alias("dst"))
    alive = over.join(known, "dst", "left_anti").select("src").union(over.join(called.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src"))
    judged = asked.join(members, has == F.col("_p"), "left_anti")
    for spared in (_entered(g), called, ids(over, "dst"), ids(alive, "src")):
        judged = judged.join(spared, "id", "left_anti")
    first = over.groupBy(F.col("src").alias("_o")).agg(F.min("dst").alias("implements"))
    told = judged.join(first, F.col("id") == F.col("_o"), "left").join(tested.withColumnRenamed("id", "_t"), F.col("id") == F.col("_t"), "left")
    methods = told.select("id", F.lit("method").alias("what"), F.when(F.col("visible"), "info").otherwise("warning").alias("severity"), F.col("_t").isNotNull().alias("tested"), "implements")
    return fields.select("id", F.lit("field").alias("what"), F.lit("info").alias("severity"), F.lit(False).alias("tested"), F.lit(None).cast("string").alias("implements")).unionByName(methods)


def version_conflicts(g: G.Graph) -> DataFrame:
    """src, name, versions: modules that depend on several versions of one artifact, whose ids are artifact:group:name:version."""
    parts = F.split(F.substr("dst", F.lit(len("artifact:") + 1)), ":")
    deps = g.edges.where("kind = 'DEPENDS_ON_ARTIFACT' and dst like 'artifact:%:%:%'").select("src", F.concat_ws(":", parts[0], parts[1]).alias("name"), parts[2].alias("version")).distinct()
    return deps.groupBy("src", "name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("version")), ",").alias("versions")).where("n > 1").select("src", "name", "versions")


def god_classes(g: G.Graph, degrees: DataFrame, top: int = 10) -> DataFrame:
    """The classes most others depend on, two at least; a top-k report, ties by id."""
    return degrees.where("n >= 2").orderBy(F.desc("n"), "id").limit(top)


def untested_gods(g: G.Graph, degrees: DataFrame) -> DataFrame:
    """Those of the god classes that belong to the project and that no test reaches."""
    own = g.nodes.where("origin = 'REPO'").select("id")
    tested = g.edges.where("kind = 'TESTS'").select(F.col("dst").alias("id")).distinct()
    return god_classes(g, degrees).join(own, "id", "left_semi").join(tested, "id", "left_anti")
