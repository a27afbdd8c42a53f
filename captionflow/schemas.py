"""Schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "captions": "listing_id long, photo_id long, url string, caption string",
    "noun_phrase_source": "listing_id long, photo_id long, url string, sentence string",
    "noun_phrases": "listing_id long, photo_id long, url string, sentence string, noun_phrases array<string>",
    "detections_text": "listing_id long, photo_id long, category string, attributes string, is_indoor string",
    "detections": "listing_id long, photo_id long, category array<struct<prob: double, name: string>>, attributes array<struct<prob: double, name: string>>, is_indoor struct<mean: double, flag: boolean>",
    "box_features_text": "listing_id string, photo_id string, image_w string, image_h string, vfov string, features string, boxes string, cls_prob string, attr_prob string, featureViewIndex string, featureHeading string, featureElevation string",
    "panorama_features_text": "scanId string, viewpointId string, image_w string, image_h string, vfov string, features string, boxes string, cls_prob string, attr_prob string, featureViewIndex string, featureHeading string, featureElevation string, viewHeading string, viewElevation string",
    "panorama_features_short": "scanId string, viewpointId string, image_w string, image_h string, vfov string, features string, boxes string, cls_prob string, featureViewIndex string, featureHeading string, featureElevation string, viewHeading string, viewElevation string",
    "boxes": "image long, box int, confidence double, x1 double, y1 double, x2 double, y2 double",
    "image_record": "listing_id long, photo_id long, bbox array<array<float>>, image_width int, image_height int, feature array<array<float>>, cls_prob array<array<float>>",
    "item": "listing_id long, photo_id long, instructions array<string>",
    "merged_item": "listing_id long, photo_id long, instructions array<string>, merging array<long>, weights array<double>, room string",
    "navigation": "instructions array<string>, path array<string>, scan string, heading double",
    "perturbed": "instructions array<string>, path array<string>, scan string, heading double, perturbations array<array<string>>",
    "corrupted": "instructions array<string>, path array<string>, scan string, heading double, corrupted array<boolean>",
    "highlighted": "instructions array<string>, path array<string>, scan string, heading double, perturbations array<array<string>>, highlights array<array<string>>, perturbation_highlights array<array<array<string>>>",
    "segment": "text string, start int, end int, mode string, cand array<string>",
    "record": "listing_id long, state string, title string, rating double, person_capacity int, property_type string, description string, amenities map<string, array<struct<title: string, subtitle: string>>>, location string, lat double, lng double, neighborhood string, getting_around string, sleeping array<struct<title: string, subtitle: string>>",
    "review": "listing_id long, review_id long, comment string, created_at string, language string, is_superhost boolean",
    "image": "photo_id long, listing_id long, location string, state string, caption string",
    "audit": "reason string, location string, listing_id long",
    "keys": "key string",
    "hierarchy": "name string, category string",
    "work_split": "split int, name string, dest string",
    "test_sample": "listing_id long, positive array<long>, neg_captions array<array<long>>, neg_images array<array<long>>, neg_randoms array<array<long>>",
    "tree_node": "tree long, node int, parent int, ord int, node_type string, word string, attributes array<string>",
    "graph_node": "scan string, image_id string, included boolean",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def names() -> tuple[str, ...]:
    return tuple(_DDL)
