"""Plant requests: nested JSON to dimension tables, and routing by plant kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmwatt import schemas

SOLAR, WIND = 0, 1


def with_route(requests: DataFrame) -> DataFrame:
    """Requests with their ``route``; a kind that is not known goes to ``rejected``."""
    kind = F.col("TipoMensaje")
    route = F.when(kind == SOLAR, "solar").when(kind == WIND, "wind").otherwise("rejected")
    return requests.withColumn("route", route)


def dispatch_log(requests: DataFrame) -> DataFrame:
    """One row per request with its route."""
    message = F.when(F.col("route") == "rejected", "unknown plant kind").otherwise("ok")
    return with_route(requests).select("plant_id", "route", message.alias("message"))


def with_problem(requests: DataFrame) -> DataFrame:
    """Requests with their route and ``problem``: NULL, or why no plan can take them."""
    routed = with_route(requests)

    def configured(schema: str) -> Column:
        return F.from_json("CuerpoMensaje", schema)["ParametrosConfiguracion"].isNotNull()

    solar = F.when(F.col("route") == "solar", configured(schemas.SOLAR_BODY))
    wind = F.when(F.col("route") == "wind", configured(schemas.WIND_BODY))
    readable = F.coalesce(solar, wind, F.lit(False))
    unknown = F.when(F.col("route") == "rejected", "unknown plant kind")
    return routed.withColumn("problem", F.coalesce(unknown, F.when(~readable, "request cannot be read")))


def accepted(requests: DataFrame, route: str) -> DataFrame:
    """Requests of one kind that can be read."""
    return with_problem(requests).filter((F.col("route") == route) & F.col("problem").isNull()).drop("route", "problem")


def request_status(requests: DataFrame) -> DataFrame:
    """Requests that no plan can take, as rows of the plant status."""
    failing = with_problem(requests).filter("problem IS NOT NULL")
    return failing.groupBy("plant_id", F.lit("request").alias("task"), F.col("problem").alias("message")).agg(
        F.count("*").alias("n_bad")
    )


def _common(prefix: str = "t") -> list:
    names = {
        "NombrePlanta": "name", "Cen": "cen", "Ihf": "ihf", "Ppi": "ppi", "Kpc": "kpc",
        "Kt": "kt", "Kin": "kin", "Latitud": "lat", "Longitud": "lon",
        "InformacionMedida": "measured",
    }
    return [F.col(f"{prefix}.{k}").alias(v) for k, v in names.items()]


def wind_dimensions(requests: DataFrame) -> dict[str, DataFrame]:
    """Plants, towers, models, curve points, turbines and cable strings."""
    body = requests.select(
        "plant_id", F.from_json("CuerpoMensaje", schemas.WIND_BODY).alias("b")
    ).select(
        "plant_id",
        F.col("b.ParametrosTransversales").alias("t"),
        F.col("b.ParametrosConfiguracion").alias("c"),
        F.col("b.ArchivoSeries.Nombre").alias("series_file"),
    )
    plants = body.select(
        "plant_id",
        *_common(),
        F.col("t.Offshore").alias("offshore"),
        F.col("t.Voltaje").alias("kv"),
        F.col("t.Latitud").alias("pcc_lat"),
        F.col("t.Longitud").alias("pcc_lon"),
        F.col("t.Elevacion").alias("pcc_elev"),
        "series_file",
    )
    tower = body.select("plant_id", F.explode("c.SistemasDeMedicion").alias("s"))
    towers = tower.select(
        "plant_id",
        F.col("s.IdentificadorTorre").alias("tower_id"),
        F.col("s.Latitud").alias("lat"),
        F.col("s.Longitud").alias("lon"),
        F.col("s.Elevacion").alias("elev"),
        F.col("s.RadioRepresentatividad").alias("radius_km"),
        F.col("s.ArchivoSeriesRelacionado").alias("series_file"),
    )
    # A model's content without its turbines; plants may use one name for different models.
    content = F.to_json(
        F.col("m").dropFields("EspecificacionesEspacialesAerogeneradores", "CantidadAerogeneradores")
    )
    model = body.select("plant_id", F.posexplode("c.Aerogeneradores").alias("m_pos", "m")).withColumn(
        "model_key", F.sha2(content, 256)
    )
    models = model.select(
        "plant_id",
        "model_key",
        F.col("m.ModeloAerogenerador").alias("model_id"),
        F.col("m.AlturaBuje").alias("hub"),
        F.col("m.DiametroRotor").alias("rotor_d"),
        F.col("m.PotenciaNominal").alias("p_nom"),
        F.col("m.VelocidadNominal").alias("v_nom"),
        F.col("m.DensidadNominal").alias("rho_nom"),
        F.col("m.VelocidadCorteInferior").alias("v_min"),
        F.col("m.VelocidadCorteSuperior").alias("v_max"),
        F.col("m.TemperaturaAmbienteMinima").alias("t_min"),
        F.col("m.TemperaturaAmbienteMaxima").alias("t_max"),
    )
    points = model.select(
        "plant_id",
        "model_key",
        F.col("m.ModeloAerogenerador").alias("model_id"),
        F.posexplode("m.CurvasDelFabricante").alias("idx", "p"),
    ).select(
        "plant_id", "model_key", "model_id", "idx",
        F.col("p.SerieVelocidad").alias("v"),
        F.col("p.SeriePotencia").alias("p"),
        F.col("p.SerieCoeficiente").alias("ct"),
    )
    turbines = model.select(
        "plant_id", "m_pos", "model_key",
        F.col("m.ModeloAerogenerador").alias("model_id"),
        F.posexplode("m.EspecificacionesEspacialesAerogeneradores").alias("t_pos", "e"),
    ).select(
        "plant_id",
        F.col("e.Aerogenerador").alias("turbine_id"),
        # Declaration order over all models, without counting the ones before.
        (F.col("m_pos").cast("bigint") * 4294967296 + F.col("t_pos")).alias("ordinal"),
        "model_key",
        "model_id",
        F.col("e.Latitud").alias("lat"),
        F.col("e.Longitud").alias("lon"),
        F.col("e.Elevacion").alias("elev"),
        F.col("e.MedicionAsociada.Value").alias("declared_tower"),
    )
    string = body.select("plant_id", F.posexplode("c.ParametroConexion").alias("string_pos", "x"))
    strings = string.select("plant_id", "string_pos", F.col("x.Resistencia").alias("ohm"))
    links = string.select(
        "plant_id", "string_pos", F.posexplode("x.ConexionAerogenerador").alias("pos", "l")
    ).select(
        "plant_id", "string_pos", "pos", F.col("l.IdentificadorAerogenerador").alias("turbine_id")
    )
    return {
        "plants": plants, "towers": towers, "models": models, "points": points,
        "turbines": turbines, "strings": strings, "links": links,
    }


def solar_dimensions(requests: DataFrame) -> dict[str, DataFrame]:
    """Plants, inverters, modules and arrays; inverters are numbered by position."""
    body = requests.select(
        "plant_id", F.from_json("CuerpoMensaje", schemas.SOLAR_BODY).alias("b")
    ).select(
        "plant_id",
        F.col("b.ParametrosTransversales").alias("t"),
        F.col("b.ParametrosConfiguracion").alias("c"),
        F.col("b.ArchivoSeries.Nombre").alias("series_file"),
    )
    plants = body.select(
        "plant_id",
        *_common(),
        F.col("t.ZonaHoraria").alias("tz"),
        F.col("t.Altitud").alias("altitude"),
        F.col("t.Albedo").alias("albedo"),
        F.col("t.L").alias("l_pct"),
        "series_file",
    )
    group = body.select(
        "plant_id", F.posexplode("c.GrupoInversores").alias("inverter_id", "g")
    )
    names = {
        "ReferenciaInversor": "inverter_model", "NInv": "n_inv", "PACnominal": "paco",
        "PDCnominal": "pdco", "VDCnominal": "vdco", "PDCarranque": "pso", "PACnocturnoW": "pnt",
        "PowerAc": "p_ac_points", "PowerDc": "p_dc_points",
    }
    inverters = group.select(
        "plant_id", "inverter_id",
        *[F.col(f"g.ParametrosInversor.{k}").alias(v) for k, v in names.items()],
    )
    names = {
        "ReferenciaModulo": "module_model", "Tnoct": "t_noct", "Tecnologia.Value": "technology",
        "Ns": "cells", "Iscstc": "i_sc_stc", "Vocstc": "v_oc_stc", "Impstc": "i_mp_stc",
        "Vmpstc": "v_mp_stc", "AlphaSc": "alpha_sc", "BetaOc": "beta_oc",
        "GammaPmp": "gamma_pmp", "Pnominalstc": "p_stc", "Psi": "psi", "Bifacial": "bifacial",
        "Bifacialidad": "bifaciality", "AltoFilaPaneles": "row_height",
        "AnchoFilaPaneles": "row_width",
    }
    modules = group.select(
        "plant_id", "inverter_id",
        *[F.col(f"g.ParametrosModulo.{k}").alias(v) for k, v in names.items()],
    )
    names = {
        "CantidadSerie": "modules_per_string", "CantidadParalero": "strings",
        "OAzimutal": "axis_az", "OElevacion": "axis_tilt", "Racking.Value": "racking",
        "OMax": "max_angle",
    }
    arrays = group.select(
        "plant_id", "inverter_id",
        F.col("g.EstructuraYConfiguracion.EstructuraPlantaConSeguidores").alias("tracker"),
        F.posexplode("g.EstructuraYConfiguracion.CantidadPanelConectados").alias("array_id", "a"),
    ).select(
        "plant_id", "inverter_id", "array_id", "tracker",
        *[F.col(f"a.{k}").alias(v) for k, v in names.items()],
    )
    return {"plants": plants, "inverters": inverters, "modules": modules, "arrays": arrays}
