"""A source-file corpus derived from the document table.

The given documents are prose.  Every document becomes one file: a short template in one
of the four languages followed by the whole document as line comments.  The number of
files, lines and bytes therefore grows with the documents.  Diagnostics come from
``lineitem``, status changes from ``events``.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_FILLER_PY = "\n".join(f"    step_{n} = value" for n in range(62))
_FILLER_JAVA = "\n".join(f"        int step{n} = value;" for n in range(64))
_FILLER_CS = "\n".join(f"        int step{n} = value;" for n in range(64))
_FILLER_JS = "\n".join(f"  let step{n} = value;" for n in range(63))

# (language, extension, text); the position is the template number.
TEMPLATES = (
    ("python", ".py", '''import os
import hashlib

def find_user(cursor, request):
    name = request.args.get("username")
    cursor.execute("SELECT * FROM users WHERE name = '" + name + "'")
    return cursor.fetchone()

def digest(value):
    return hashlib.md5(value).hexdigest()'''),
    ("java", ".java", '''import java.util.Random;
public class Lottery {
    private String password = "letmein-please";
    public int draw() {
        Random source = new Random();
        return source.nextInt(49);
    }
    public void load(java.io.ObjectInputStream in) {
        try { Object o = in.readObject(); } catch (Exception e) { }
    }
}'''),
    ("csharp", ".cs", '''using System;
namespace Shop.Data
{
    public class Orders
    {
        public int Count { get; set; }
        public string Find(string id)
        {
            var cmd = new SqlCommand("SELECT * FROM Orders WHERE Id=" + id, conn);
            if (id != null)
            {
                return cmd.ExecuteScalar().ToString();
            }
            return "";
        }
    }
}'''),
    ("javascript", ".js", '''const token = "0123456789abcdef0123";
function show(user) {
  document.getElementById("box").innerHTML = user.name;
  if (user.level == 3) {
    console.log(user.level);
  }
  window.postMessage(user, "*");
}'''),
    ("python", ".py", '''import random

def pick(values):
    # TODO: use a better source
    token = random.choice(values)
    session = {"login": token}
    return session

def total(values, seen=[]):
    result = ""
    for value in values:
        result += value
    return result'''),
    ("java", ".java", '''public class Repository {
    public Object find(EntityManager em, String name) {
        return em.createQuery("from User u where u.name = '" + name + "'").getSingleResult();
    }
    public String city(Customer c) {
        return c.getAddress().toString();
    }
}'''),
    ("csharp", ".cs", '''using System;
using System.IO;
public class Upload
{
    public void Save()
    {
        var path = Path.Combine(root, Request.Query);
        Response.Write("saved " + Request.Path);
        try { File.Delete(path); } catch { }
    }
}'''),
    ("javascript", ".mjs", '''export async function load(url) {
  const reply = await fetch(url);
  const text = await reply.text();
  eval(text);
  localStorage.setItem("auth_token", text);
  return Object.assign({}, JSON.parse(text));
}'''),
    ("python", ".py", '''def classify(order, limit, flags):
    score = 0
    if order > limit and flags:
        score = 1
    elif order < 0 or limit < 0:
        score = 2
    for flag in flags:
        if flag and order and limit:
            score = 3
        while score > 9:
            score = score - 1
    try:
        with open("rates.txt") as handle:
            rates = [line for line in handle if line]
    except OSError:
        rates = []
    assert score >= 0
    return sum(rates) if rates else score'''),
    ("java", ".java", '''public class Worker {
    public void run() {
        try {
            step();
        } catch (RuntimeException e) {
            e.printStackTrace();
        }
        // FIXME retry
    }
}'''),
    ("csharp", ".cs", '''namespace Shop.Tools;
public class Codec
{
    private static string password = "correct horse battery";
    public static byte[] Hash(byte[] data) => MD5.Create().ComputeHash(data);
    public object Read(Stream s) => new BinaryFormatter().Deserialize(s);
    // HACK: remove
}'''),
    ("javascript", ".js", '''class Counter {
  add(n) {
    if (n === 0) { return; }
    this.total = this.total + n;
  }
}
// TODO: tests'''),
    ("python", ".py", '''import yaml, pickle, subprocess

def read(stream, path):
    config = yaml.load(stream)
    safe = yaml.load(stream, Loader=yaml.SafeLoader)
    blob = pickle.loads(stream.read())
    subprocess.run("ls " + path, shell=True)
    try:
        data = open("/srv/" + path).read()
    except:
        print("failed")
    return config, safe, blob, data'''),
    ("java", ".java", '''public class Long {
    public int first(int value) {
''' + _FILLER_JAVA + '''
        return value;
    }
    public int second(int value) {
        return value;
    }
}'''),
    ("csharp", ".cs", '''using System.Threading.Tasks;
public class Jobs
{
    public async Task Run(int value)
    {
''' + _FILLER_CS + '''
        while (value > 0)
        {
            if (value == 3)
            {
                value = value - 1;
            }
        }
    }
    private unsafe struct Cell { }
    public void Stop()
    {
        unsafe { value = 1; }
    }
}'''),
    ("javascript", ".js", '''function first(value) {
''' + _FILLER_JS + '''
  return value;
}
function second(value) {
  document.write(value);
  return value;
}'''),
    ("python", ".py", '''def long_one(value):
''' + _FILLER_PY + '''
    return value

async def short_one(value):
    return value'''),
    ("java", ".java", '''public class Clean {
    private final int size;
    public Clean(int size) {
        this.size = size;
    }
}'''),
    ("csharp", ".cs", '''public struct Point
{
    public int X { get { return x; } }
    public int Y { get; set; }
    private int x;
}'''),
    ("javascript", ".js", '''const area = (w, h) => w * h;
const unit = { scale: function (x) { return x; } };'''),
    ("python", ".py", '''from flask import Flask

app = Flask(__name__)

@app.route("/")
def index():
    return "ok"

app.run(debug=True)'''),
    ("java", ".java", '''package demo;
interface Shape {
    double area();
}'''),
    ("csharp", ".cs", '''public enum Level { Low, High }
public static class Text
{
    public static string Join(string a, string b)
    {
        var s = a;
        s += b;
        return s;
    }
}'''),
    ("javascript", ".js", '''const rows = items.filter(x => x.ok).map(x => x.id);
for (const row of rows) {
  render(row);
}'''),
    ("python", ".py", '''import logging

log = logging.getLogger(__name__)


def add(a, b):
    """Sum of two numbers."""
    log.debug("add")
    return a + b'''),
    ("java", ".java", '''public class Sums {
    public static int add(int a, int b) { return a + b; }
}'''),
    ("csharp", ".cs", '''using System;
public class Greeting
{
    public void Say() { Console.WriteLine("hello"); }
}'''),
    ("javascript", ".js", '''export const add = (a, b) => a + b;'''),
    ("python", ".py", '''import os, hashlib

API_KEY = "k3y-for-the-demo"

def remove(path):
    os.system("rm " + path)
    exec("done = True")
    query = "DELETE FROM files WHERE path = '{}'".format(path)
    return hashlib.sha1(path).hexdigest(), query'''),
    ("java", ".java", '''public class Secrets {
    String apiKey = "0000-1111-2222";
    String note = "plain";
}'''),
    ("csharp", ".cs", '''public class Config
{
    string connectionString = "Server=db;User=app;Pwd=app";
    void Load() { try { Read(); } catch (Exception e) { } }
}'''),
    ("javascript", ".js", '''const options = { api_key: "AAAAAAAAAAAAAAAAAAAA", mode: "fast" };
element.innerHTML == "" && reset();'''),
    ("python", ".py", '''def outer(rows, strict):
    def inner(row):
        if row.a and row.b or row.c:
            return 1
        if row.d:
            return 2
        if row.e:
            return 3
        for x in row.items:
            if x and strict:
                return 4
        while row.next:
            row = row.next
        assert row
        return [y for y in row.items if y]
    for row in rows:
        yield inner(row)'''),
    ("java", ".java", '''public class Notes {
    // XXX unclear
    // plain remark
    void noop() { }
}'''),
    ("csharp", ".cs", '''namespace A
{
    namespace B
    {
        public class Deep
        {
            void Go(int n)
            {
                if (n > 0) { while (n > 1) { for (;;) { n = n - 1; } } }
            }
        }
    }
}'''),
    ("javascript", ".js", '''const handler = async function (event) {
  const form = event.target.form;
  try { await send(form); } catch (err) { console.debug(err); }
};'''),
    ("python", ".py", '''x = eval("1 + 1")
y = ast.literal_eval("[1]")
# eval( in a comment counts as well'''),
    ("java", ".java", '''public class Empty {
}'''),
    ("csharp", ".cs", '''// only a remark'''),
    ("javascript", ".js", '''"use strict";'''),
)

COMMENT = {"python": "# ", "java": "// ", "csharp": "// ", "javascript": "// "}
ORDERS_PER_FILE = 15        # the given tables hold 15 orders for each document
UPLOAD_EPOCH = 1_700_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(table: DataFrame, key: str) -> DataFrame:
    """Use all cores on an input too small for them.

    Scanning is bound by processor time.  A table read in fewer pieces than there are cores
    (one small parquet file is a single piece) is redistributed once by key; a large table
    already has many pieces and is left as it is, without a shuffle.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores, key)


def templates(spark: SparkSession) -> DataFrame:
    rows = [(n, language, ext, COMMENT[language], text)
            for n, (language, ext, text) in enumerate(TEMPLATES)]
    return spark.createDataFrame(
        rows, "template int, language string, extension string, comment string, head string")


def files_of(documents: DataFrame) -> DataFrame:
    """Documents as files: ``file_id, project_id, filename, language, source``.  The 40
    templates are broadcast.

    The lines of the text become remarks; the template stands behind as many of them as the
    length of the text says, so that places and surroundings differ from file to file.
    """
    spark = documents.sparkSession
    numbered = documents.withColumn("template", (F.col("doc_id") % len(TEMPLATES)).cast("int"))
    joined = numbered.join(F.broadcast(templates(spark)), "template")
    return joined.select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("project_id"),
        F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.col("extension")).alias("filename"),
        "language",
        F.expr("transform(array(transform(split(text, '\\n'), x -> concat(comment, x))), l -> array_join(concat("
               "slice(l, 1, length(text) % (size(l) + 1)), array(head), "
               "slice(l, 1 + length(text) % (size(l) + 1), size(l))), '\\n'))[0]").alias("source"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return files_of(spread(documents, "doc_id"))


def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files without their text; the document text is not read."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", F.col("source"), F.lit("").alias("text"))
    return files_of(documents).drop("source") \
        .withColumn("uploaded_at", F.col("file_id") + UPLOAD_EPOCH)


def project_name(project_id: Column) -> Column:
    return F.concat(F.lit("Project "), project_id)


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project per document source, created with its first document."""
    return (read_table(spark, sf_dir, "documents").groupBy("source")
            .agg(F.min("doc_id").alias("first"), F.max("lang").alias("lang"))
            .select(F.col("source").alias("project_id"),
                    project_name(F.col("source")).alias("name"),
                    F.concat(F.lit("Documents, among them "), F.col("lang")).alias("description"),
                    (F.col("first") * 86400 + UPLOAD_EPOCH).alias("created_at")))


def _file_of(order_key: Column) -> Column:
    return F.floor(order_key / ORDERS_PER_FILE).cast("long")


def _feed_position() -> Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def _tie_break() -> Column:
    """Order lines may share order and line number; this tells them apart."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                       F.col("l_quantity").cast("int").cast("string"), cents.cast("string"))


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    return spread(lines, "l_orderkey")


def java_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One compiler diagnostic per order line, for all files; those of other languages
    fall away when the feed is applied."""
    kind = (F.when(F.col("l_returnflag") == "A", "ERROR")
            .when(F.col("l_linestatus") == "O", " warning ")
            .when(F.col("l_returnflag") == "R", "MANDATORY_WARNING").otherwise("NOTE"))
    line = F.when(F.col("l_quantity") >= 49, "n/a") \
        .otherwise((F.col("l_linenumber") * 3 - 5).cast("string"))
    return _order_lines(spark, sf_dir).select(
        _file_of(F.col("l_orderkey")).alias("file_id"), _feed_position().alias("seq"),
        _tie_break().alias("sub"), kind.alias("kind"), line.alias("line"),
        F.when(F.col("l_tax") == 0.08, "  ")
        .otherwise(F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).alias("message"),
        F.when(F.col("l_discount") == 0.0, "")
        .otherwise(F.concat(F.lit("\tuse("), F.col("l_suppkey").cast("string"), F.lit(") "))).alias("source_fragment"))


def csharp_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of the C# service as JSON text, one per order line; a tenth of the parts
    yields broken JSON."""
    severity = (F.when(F.col("l_returnflag") == "A", "Error").when(F.col("l_returnflag") == "R", "Warning")
                .otherwise("Hidden"))
    response = F.concat(
        F.lit('{"diagnostics":[{"severity":"'), severity,
        F.lit('","id":"'), F.when(F.col("l_tax") == 0.0, "").otherwise(F.concat(F.lit("CS0"), (F.col("l_suppkey") % 7 + 100).cast("string"))),
        F.lit('","message":"part '), F.col("l_partkey").cast("string"),
        F.lit('","line":"'), (F.col("l_linenumber") * 3 - 5).cast("string"),
        F.lit('","source_fragment":""}],"findings":[{"rule_id":"'),
        F.when(F.col("l_linestatus") == "O", "CS-SEC-002").otherwise("CS-PERF-001"),
        F.lit('","title":"'), F.when(F.col("l_discount") == 0.1, "").otherwise("Service rule"),
        F.lit('","severity":"'), F.when(F.col("l_discount") < 0.03, " HIGH ").otherwise("urgent"),
        F.lit('","category":"'), F.when(F.col("l_discount") < 0.05, "Style").otherwise("other"),
        F.lit('","line":"'), F.col("l_linenumber").cast("string"),
        F.lit('","snippet":" s'), F.col("l_linenumber").cast("string"),
        F.lit('","cwe_id":"CWE-1"}]}'))
    broken = F.substr(response, F.lit(1), F.length(response) - 3)
    return _order_lines(spark, sf_dir).select(
        _file_of(F.col("l_orderkey")).alias("file_id"), _feed_position().alias("seq"),
        _tie_break().alias("sub"),
        F.when(F.col("l_tax") == 0.07, broken).otherwise(response).alias("response"))


def status_of_events(events: DataFrame) -> DataFrame:
    """Status changes of files, one per event: the user number names the file."""
    status = (F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "analyzing")
              .when(F.col("event_type") == "purchase", "complete").otherwise("pending"))
    return events.select(F.col("user_id").alias("file_id"), F.col("ts").cast("timestamp").alias("ts"),
                         "event_id", status.alias("status"))


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_of_events(read_table(spark, sf_dir, "events"))
