"""What annotations wire together: beans and what they are injected into, routes, jobs and listeners, derived from the nodes' attributes.

The names of the annotations are parameters; their defaults are those of one web framework. All rules are joins on ids, types and names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.common import cut
from graphloom.functions.names import annotations, member, short_class
from graphloom.operators import graph as G
from graphloom.operators.walk import closure

#: Annotations of one web framework by what they mean.
STEREOTYPES = tuple(f"org.springframework.stereotype.{s}" for s in ("Component", "Service", "Repository", "Controller")) + (
    "org.springframework.web.bind.annotation.RestController", "org.springframework.context.annotation.Configuration")
CONFIGURATIONS = ("org.springframework.context.annotation.Configuration", "org.springframework.boot.autoconfigure.SpringBootApplication")
BEAN, PRIMARY, PROFILE = (f"org.springframework.context.annotation.{s}" for s in ("Bean", "Primary", "Profile"))
QUALIFIER = "org.springframework.beans.factory.annotation.Qualifier"
INJECT = ("org.springframework.beans.factory.annotation.Autowired", "jakarta.inject.Inject", "javax.inject.Inject", "jakarta.annotation.Resource", "javax.annotation.Resource")
CONTROLLERS = ("org.springframework.stereotype.Controller", "org.springframework.web.bind.annotation.RestController")
MAPPINGS = {f"org.springframework.web.bind.annotation.{v}Mapping": v.upper() for v in ("Get", "Post", "Put", "Delete", "Patch")}
PREFIX = "org.springframework.web.bind.annotation.RequestMapping"
SCHEDULED = ("org.springframework.scheduling.annotation.Scheduled",)
LISTENERS = {"org.springframework.kafka.annotation.KafkaListener": "topics", "org.springframework.amqp.rabbit.annotation.RabbitListener": "queues", "org.springframework.jms.annotation.JmsListener": "destination"}
#: Types that hold a bean, or several of a type; supertypes of a data framework, and how deep types and annotations are followed to them.
WRAPPERS = {"java.util.List": True, "java.util.Set": True, "java.util.Collection": True, "java.util.Map": True, "java.util.Optional": False, "org.springframework.beans.factory.ObjectProvider": False}
DATA_TYPES, META_DEPTH, TYPE_DEPTH = ("org.springframework.data.", "Repository"), 3, 5


def notes(nodes: DataFrame) -> DataFrame:
    """id, note, members: each annotation of each node."""
    return nodes.select("id", F.explode(annotations("attrs")).alias("note", "members"))


def first_of(*names: str) -> Column:
    """The first of some members of an annotation that is there and not blank."""
    return F.coalesce(*(F.when(F.trim(F.try_element_at("members", F.lit(n))) != "", F.try_element_at("members", F.lit(n))) for n in names))


def meta_annotations(g: G.Graph, wanted: tuple[str, ...], depth: int = META_DEPTH) -> DataFrame:
    """note: wanted annotations and those that carry one of them, through others too, depth steps deep."""
    spark = g.nodes.sparkSession
    carried = notes(g.nodes.where("kind = 'ANNOTATION'")).select("id", "note")
    known = spark.createDataFrame([(w,) for w in wanted], "note string")
    for _ in range(depth):
        known = known.union(carried.join(known, "note").select(F.col("id").alias("note"))).distinct()
    return known


def bean_name(cls: Column | str) -> Column:
    """The name of a class with a small first letter, unless two capitals begin it."""
    name = short_class(cls)
    return F.when(name.rlike("^[A-Z][A-Z]"), name).otherwise(F.concat(F.lower(F.substring(name, 1, 1)), F.substr(name, F.lit(2))))


def beans(g: G.Graph, stereotypes: tuple[str, ...] = STEREOTYPES, configurations: tuple[str, ...] = CONFIGURATIONS, bean: str = BEAN) -> DataFrame:
    """id, name, type, provider, primary, qualifier, profile: classes with a stereotype, also one that an annotation of theirs carries, interfaces of a data framework, and
    the methods of configuration classes that make a bean. Of one name with several types, the type is part of the id."""
    own = cut(notes(g.nodes))
    of = lambda note, value, name: own.where(F.col("note") == note).groupBy(F.col("id").alias("_id")).agg(F.max(value).alias(name))
    types = g.nodes.where(G.is_code()).select("id", "kind")
    stereotyped = own.join(meta_annotations(g, stereotypes), "note", "left_semi").groupBy("id").agg(F.min(F.struct("note", first_of("value", "name").alias("name")))["name"].alias("given"))
    begin, end = DATA_TYPES
    above = g.edges.where("kind in ('EXTENDS', 'IMPLEMENTS')").select("src", "dst")
    found = above.where(F.startswith("dst", F.lit(begin)) & F.endswith("dst", F.lit(end))).select(F.col("src").alias("id"))
    for _ in range(TYPE_DEPTH - 1):
        found = found.union(above.join(found.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"))).distinct()
    stored = types.where("kind = 'INTERFACE'").join(found, "id", "left_semi").join(stereotyped, "id", "left_anti").select("id", F.lit(None).cast("string").alias("given"))
    classes = types.select("id").join(stereotyped, "id").unionByName(stored).select("id", F.coalesce("given", bean_name("id")).alias("name"), F.col("id").alias("type"), F.col("id").alias("provider"))
    makers = own.where(F.col("note").isin(*configurations)).select(F.col("id").alias("src")).distinct().join(types.withColumnRenamed("id", "src"), "src", "left_semi")
    signatures = g.nodes.where("kind = 'METHOD' and signature is not null").select(F.col("id").alias("dst"), "signature")
    made = g.edges.where("kind = 'CONTAINS'").join(makers, "src", "left_semi").join(signatures, "dst").join(own.where(F.col("note") == bean).select(F.col("id").alias("dst"), first_of("name", "value").alias("given")), "dst")
    type_ = F.trim(F.substring_index("signature", ": ", -1))
    methods = made.select(F.col("dst").alias("id"), F.substring_index(F.coalesce("given", F.substring_index(member("dst"), "(", 1)), ",", 1).alias("name"), type_.alias("type"), F.col("dst").alias("provider"))
    told = classes.unionByName(methods)
    for note, value, name in ((PRIMARY, F.lit(True), "primary"), (QUALIFIER, first_of("value"), "qualifier"), (PROFILE, first_of("value"), "profile")):
        told = told.join(of(note, value, name), F.col("id") == F.col("_id"), "left").drop("_id")
    several = F.size(F.collect_set("type").over(Window.partitionBy("name"))) > 1
    id_ = F.concat(F.lit("bean:"), "name", F.when(several, F.concat(F.lit("@"), "type")).otherwise(""))
    return told.select(id_.alias("id"), "name", "type", "provider", F.coalesce("primary", F.lit(False)).alias("primary"), "qualifier", "profile").distinct()


def injections(g: G.Graph, found: DataFrame, inject: tuple[str, ...] = INJECT) -> DataFrame:
    """src, dst, resolution, confidence: what each bean class is given, by its annotated fields, setters and constructor, or its only constructor.

    found: beans. A qualifier names its bean; else beans of the type or below it, those without a profile where there are any; of a collection all, else the only one, else the
    primary ones, else each with its share. A type without beans comes from elsewhere and has no row."""
    own = cut(notes(g.nodes))
    classes = found.where("provider = type").select(F.col("provider").alias("cls")).distinct()
    held = g.edges.where("kind = 'CONTAINS'").select(F.col("src").alias("cls"), F.col("dst").alias("id")).join(classes, "cls", "left_semi").join(g.nodes.select("id", "kind", "signature"), "id")
    marked = own.where(F.col("note").isin(*inject)).select("id", F.lit(True).alias("_marked")).distinct()
    named = own.where(F.col("note") == QUALIFIER).groupBy("id").agg(F.max(first_of("value")).alias("asked"))
    resources = own.where(F.col("note").endswith(".Resource")).groupBy("id").agg(F.max(first_of("name")).alias("_resource"))
    rows = held.join(marked, "id", "left").join(named, "id", "left").join(resources, "id", "left").withColumn("asked", F.coalesce("asked", "_resource"))
    only = F.count(F.when(F.col("kind") == "CONSTRUCTOR", 1)).over(Window.partitionBy("cls")) == 1
    points = rows.withColumn("_only", only).where("_marked or (_only and kind = 'CONSTRUCTOR')")
    inside = F.regexp_extract("id", r"\((.*)\)$", 1)
    # commas inside brackets part no parameters
    listed = F.filter(F.split(F.regexp_replace(inside, r",(?![^<>]*>)", "\n"), "\n"), lambda p: p != "")
    declared = F.explode(F.when(F.col("kind") == "FIELD", F.array(F.trim(F.substring_index("signature", ": ", -1)))).when(F.col("kind").isin("METHOD", "CONSTRUCTOR"), listed))
    each = points.select("cls", "asked", declared.alias("declared")).withColumn("outer", F.substring_index("declared", "<", 1))
    many = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in WRAPPERS.items() for x in kv)), F.when(F.contains("declared", F.lit("<")), F.col("outer"))), F.lit(False))
    argument = F.regexp_extract("declared", r"<(.*)>$", 1)
    inner = F.when(F.col("outer") == "java.util.Map", F.trim(F.substring_index(argument, ",", -1))).otherwise(argument)
    wrapped = F.col("outer").isin(*WRAPPERS) & F.contains("declared", F.lit("<"))
    asks = each.select("cls", "asked", many.alias("many"), F.substring_index(F.when(wrapped, inner).otherwise(F.col("declared")), "<", 1).alias("type")).distinct().withColumn("nr", F.monotonically_increasing_id())
    asks = cut(asks)
    by_name = asks.where("asked is not null").join(found.select("id", F.explode(F.array_distinct(F.array("name", "qualifier"))).alias("asked")), "asked").select("nr", "cls", "id").distinct()
    below = closure(g.edges.where("kind in ('EXTENDS', 'IMPLEMENTS')").select("src", "dst"))
    fits = found.select("id", "type", "primary", "profile", "provider").unionByName(found.join(below, F.col("type") == F.col("src")).select("id", F.col("dst").alias("type"), "primary", "profile", "provider"))
    by_type = asks.join(by_name.select("nr").distinct(), "nr", "left_anti").join(fits, "type").where("provider <> cls").select("nr", "cls", "many", "id", "primary", "profile").distinct()
    key = Window.partitionBy("nr")
    plain = by_type.withColumn("_plain", F.max(F.col("profile").isNull()).over(key)).where("not _plain or profile is null")
    counted = plain.withColumn("n", F.count("*").over(key)).withColumn("_any", F.max("primary").over(key)).where("many or n = 1 or not _any or primary")
    sure = F.col("many") | (F.col("n") == 1) | F.col("_any")
    told = counted.select(F.col("cls").alias("src"), F.col("id").alias("dst"), F.when(sure, 1.0).otherwise(1 / F.col("n")).alias("confidence"))
    every = told.unionByName(by_name.select(F.col("cls").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("confidence")))
    best = every.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))
    return best.select("src", "dst", F.when(F.col("confidence") < 1, "HEURISTIC").otherwise("SPRING").alias("resolution"), "confidence")


def routes(g: G.Graph, controllers: tuple[str, ...] = CONTROLLERS, mappings: dict[str, str] | None = None, prefix: str = PREFIX) -> DataFrame:
    """handler, verb, path: each method of a controller class with its mappings, or those of the method that it takes its place of in a type above, the first by id; the paths of
    the class, or of the first type above that has some, stand before. A prefix annotation on a method is a mapping of the verbs it names, or of any."""
    verbs = MAPPINGS if mappings is None else mappings
    own = cut(notes(g.nodes).where(F.col("note").isin(*controllers, *verbs, prefix)))
    paths = F.transform(F.split(F.coalesce(first_of("value", "path"), F.lit("")), ","), lambda p: F.trim(p))
    above = closure(g.edges.where("kind in ('EXTENDS', 'IMPLEMENTS')").select("src", "dst"))
    classes = g.nodes.where(G.is_code()).select("id").join(own.where(F.col("note").isin(*controllers)), "id", "left_semi").select(F.col("id").alias("cls"))
    fronts = own.where(F.col("note") == prefix).select(F.col("id").alias("_at"), paths.alias("_paths"))
    first = above.join(fronts, F.col("dst") == F.col("_at")).groupBy(F.col("src").alias("_cls")).agg(F.min(F.struct("dst", "_paths"))["_paths"].alias("_above"))
    placed = classes.join(fronts, F.col("cls") == F.col("_at"), "left").join(first, F.col("cls") == F.col("_cls"), "left").select("cls", F.coalesce("_paths", "_above", F.array(F.lit(""))).alias("before"))
    named = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in verbs.items() for x in kv)), F.col("note")) if verbs else F.lit(None).cast("string"), first_of("method"), F.lit("ANY"))
    mapped = own.where(F.col("note").isin(*verbs, prefix)).where(F.contains("id", F.lit("#"))).select(F.col("id").alias("_m"), F.struct("note", paths.alias("paths"), F.transform(F.split(named, ","), lambda v: F.trim(F.substring_index(v, ".", -1))).alias("verbs")).alias("map"))
    methods = g.edges.where("kind = 'CONTAINS'").select(F.col("src").alias("cls"), F.col("dst").alias("handler")).join(placed, "cls").join(g.nodes.where("kind = 'METHOD'").select(F.col("id").alias("handler")), "handler", "left_semi")
    direct = methods.join(mapped, F.col("handler") == F.col("_m")).select("handler", "before", "map")
    rest = methods.join(mapped.select("_m"), F.col("handler") == F.col("_m"), "left_anti").join(above, F.col("cls") == F.col("src"))
    met = rest.join(mapped, F.concat("dst", F.lit("#"), member("handler")) == F.col("_m")).withColumn("_first", F.min("dst").over(Window.partitionBy("handler")))
    every = direct.unionByName(met.where("dst = _first").select("handler", "before", "map"))
    each = every.select("handler", F.explode("before").alias("before"), "map").select("handler", "before", F.explode("map.paths").alias("path"), "map.verbs").select("handler", "before", "path", F.explode("verbs").alias("verb"))
    joined = F.concat(F.lit("/"), F.array_join(F.filter(F.split(F.concat_ws("/", "before", "path"), "/"), lambda p: p != ""), "/"))
    return each.select("handler", "verb", joined.alias("path")).distinct()


def jobs(g: G.Graph, scheduled: tuple[str, ...] = SCHEDULED) -> DataFrame:
    """id, method, schedule of each method that runs by itself; schedule is what the annotation says first of its time, null for nothing."""
    found = notes(g.nodes.where("kind = 'METHOD'")).where(F.col("note").isin(*scheduled))
    return found.groupBy("id").agg(F.min(first_of("cron", "fixedRate", "fixedDelay", "value", "name")).alias("schedule")).select(F.concat(F.lit("job:"), "id").alias("id"), F.col("id").alias("method"), "schedule")


def listeners(g: G.Graph, names: dict[str, str] | None = None) -> DataFrame:
    """method, topic of each method that listens; several topics stand with commas between. names: the member that holds the topics, by annotation."""
    known = LISTENERS if names is None else names
    topics = F.coalesce(*(F.when(F.col("note") == a, first_of(m, "value")) for a, m in known.items()))
    found = notes(g.nodes.where("kind = 'METHOD'")).where(F.col("note").isin(*known)).select(F.col("id").alias("method"), F.explode(F.split(topics, ",")).alias("topic"))
    return found.select("method", F.trim("topic").alias("topic")).where("topic <> ''").distinct()
