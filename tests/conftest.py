import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


# Log entries of an imagined greenhouse: class and text. One class stands alone.
TICKETS = [
    ("浇水", "三号棚滴灌停了半天"),
    ("虫害", "番茄叶背有白粉虱，一天比一天多"),
    ("浇水", "Pump7 压力低"),
    ("采收", "草莓今早只装了六箱"),
    ("虫害", "黄瓜藤上爬满蚜虫"),
    ("浇水", "滴灌管接头漏水，换过两回照样漏"),
    ("温控", "夜里棚温掉到四度"),
    ("浇水", "水肥机不出水"),
    ("采收", "番茄熟得太快人手不够"),
    ("虫害", "北侧防虫网破了一个洞"),
    ("采收", "草莓箱少贴了标签"),
]

WORDS = ["滴灌", "滴灌管", "管接头", "番茄", "草莓", "箱", "白粉虱", "蚜虫", "虫网", "防虫网", "漏水", "出水", "不出水", "棚温", "标签"]


@pytest.fixture(scope="session")
def tickets(spark):
    rows = [(i + 1, g, t) for i, (g, t) in enumerate(TICKETS)]
    return spark.createDataFrame(rows, "doc_id long, group string, orgtext string").cache()
