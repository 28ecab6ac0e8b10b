from scriptloom.functions.statements import spark_form, statements


def test_statements():
    script = "select ';' as a, \"x;y\" from t -- no; end\n; /* ; */ ;\n select `p;q` from u;\n-- nothing\n"
    assert statements(script) == ["select ';' as a, \"x;y\" from t -- no; end", "select `p;q` from u"]
    assert statements(" \n -- only this") == [] == statements("")


def test_forms():
    assert spark_form('select a as "x y", \'say "no"\' from t') == "select a as `x y`, 'say \"no\"' from t"
    assert spark_form("/* c */ SELECT  TOP 5 a from t") == "/* c */ SELECT a from t\nLIMIT 5"
    assert spark_form("select top_speed from t") == "select top_speed from t"
