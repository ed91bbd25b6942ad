"""Table schemas of the pipeline."""

from __future__ import annotations

POINTS = "array<struct<lon:double,lat:double>>"

#: The contract between the two stages; pos is the order of the input, which decides ties.
FEATURES = f"pos long, kind string, name string, osm_id string, category string, importance int, tier string, salience string, street string, street_approx boolean, barrier_class string, geom_type string, pts {POINTS}"

GEOJSON = (
    "type string, properties struct<schemaVersion:int,title:string,bounds:array<double>>, features array<struct<type:string,"
    "properties:struct<kind:string,name:string,osmId:string,category:string,importance:int,tier:string,salience:string,street:string,streetApprox:boolean,barrierClass:string>,"
    "geometry:struct<type:string,coordinates:string>>>"
)
