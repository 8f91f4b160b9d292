def points_frame(spark, points):
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "point_id BIGINT, x DOUBLE, y DOUBLE")


def circles_frame(spark, circles):
    rows = [(i, float(x), float(y), float(r)) for i, (x, y, r) in enumerate(circles)]
    return spark.createDataFrame(rows, "circle_id BIGINT, cx DOUBLE, cy DOUBLE, r DOUBLE")


def rows(frame, *columns):
    return sorted(tuple(row) for row in frame.select(*(columns or frame.columns)).collect())
